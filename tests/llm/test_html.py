import html as escapes
import random
import re

from trellis.llm import html
from trellis.llm.queries import op6_html_main_text


def text(page, *others):
    return html.main_text(html.blocks(page), [html.blocks(o) for o in others])


def test_markup_evidence():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="menu">
    <header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id=cookie-notice>ok?</div>
    <article><header><h1>Title &amp; more&#33;</h1></header><p>a  b<br>c<p>d <b>e &lt;tag&gt;<i>f</i></b></p><form><input value=x><button>go</button>form</form>
    <aside>side</aside><div class="comments-list"><p>reader</p></div><p hidden>secret</p><pre>x
    y</pre></article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title & more!\na b c\nd e <tag>f\nx y"


def test_broken_markup():
    assert text("<article><p>one<p>two") == "one\ntwo"
    assert text("plain < text & more") == "plain < text & more"
    assert text("<p class='x>never closed") in ("", "never closed")
    assert text("<div><p>a</span></p></div></article>b") == "a\nb"
    assert text("<script>never closed <p>x</p>") == ""
    assert text("<p>a<script>1</script>b</p>") == "ab"
    assert text(None) == "" and text("") == "" and text("   ") == ""
    assert text("<p>" + "z " * 200000 + "</p>").count("z") == 200000
    assert text("<p>a</p>" * 3000).count("a") == 3000


def test_differencing_of_unmarked_pages():
    page = lambda body: f"<body><div>Brand</div><div>Menu one</div>{body}<div>All rights</div></body>"
    a, b = page("<p>first story</p><p>more</p>"), page("<p>second one</p>")
    assert text(a, b) == "first story\nmore" and text(b, a) == "second one"
    assert text(a, a, b) == "first story\nmore"  # a copy says nothing about the template
    assert text(a, a) == "Brand\nMenu one\nfirst story\nmore\nAll rights"


def test_common_lines():
    rng = random.Random(1)

    def length(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(1500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in (0, 1))
        found = html.common_lines(a, b)
        rest = iter(b)
        assert len(found) == length(a, b) and all(a[i] in rest for i in sorted(found))


def test_nearest():
    assert html.nearest("/a/b/c", ["/a/x", "/a/b/d"]) == [1, 0]


def lcs(a, b):
    """Places in a of the longest common subsequence, by the table of all prefixes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best


def brute(rows):
    """{page_id: text} of (page_id, url, html) rows of different ids: each host's pages in order, the next two on either side with other lines,
    and of those the nearest that is no copy; only where longest common subsequences of a page are unique."""
    hosts = {}
    for i, url, page in rows:
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", url).groups()
        hosts.setdefault(host.lower(), []).append((path, i, html.blocks(page)))
    out = {}
    for pages in hosts.values():
        pages.sort(key=lambda p: (p[0].encode(), p[1], html._digest(p[2])))
        for at, (path, i, lines) in enumerate(pages):
            others = []
            for side in (pages[:at][::-1], pages[at + 1 :]):
                seen = []
                for p, _, x in side:
                    if x != lines and x not in [s for _, s in seen] and len(seen) < 2:
                        seen.append((p, x))
                others += seen

            def prefix(p, path=path):
                return next((k for k, (u, v) in enumerate(zip(p, path)) if u != v), min(len(p), len(path)))

            others.sort(key=lambda o: -prefix(o[0]))
            mine = [x for x, _ in lines]
            shared = []
            for _, other in others:
                there = [x for x, _ in other]
                both = set(mine) & set(there)
                assert len({x: 0 for x in mine if x in both}) == sum(x in both for x in mine)  # no repeats: one alignment
                best, i_, j_, got = lcs(mine, there), len(mine), len(there), set()
                while i_ and j_:
                    if mine[i_ - 1] == there[j_ - 1]:
                        i_, j_ = i_ - 1, j_ - 1
                        got.add(i_)
                    elif best[i_ - 1][j_] >= best[i_][j_ - 1]:
                        i_ -= 1
                    else:
                        j_ -= 1
                shared.append(got)
            weight = lambda s, mine=mine: sum(len(mine[k]) for k in s)
            gone = set()
            if shared:
                template = min(shared, key=weight)
                rest = sum(map(len, mine)) - weight(template)
                gone = [s for s in shared if s == template or weight(s - template) * 2 < rest][0]
            marked = any(k == 2 for _, k in lines)
            keep = [x for k, (x, kind) in enumerate(lines) if kind == 2 or (kind == 1 and k not in gone and (others or not marked)) or (kind == 3 and not marked and k not in gone)]
            out[i] = "\n".join(keep)
    return out


def site(rng, n, marked=False):
    """Pages of a few hosts with menus, footers, section boxes, and articles of which some come again."""
    bodies = [[f"story {k} " + " ".join(rng.choice("river hill stone cloud".split()) for _ in range(rng.randint(1, 60))) + f" {k}.{j}" for j in range(rng.randint(1, 9))] for k in range(n)]
    rows = []
    for i in range(n):
        host = rng.choice([1, 1, 1, 1, 2, 3])
        section = rng.randint(1, 4)
        body = bodies[rng.randint(0, i)] if rng.random() < 0.2 else bodies[i]
        tag = "article" if marked else "section"
        page = f"<body><div>Brand {host}</div><ul><li>Menu {host}<li>More {host}</ul><div>Section {host} {section}</div>{'<div>legal ' + 'words ' * 80 + '</div>' if host == 1 else ''}<{tag}>" + "".join(f"<p>{x}</p>" for x in body) + f"</{tag}><div class='ad'>Buy {i}</div><div>Rights of {host}</div>"
        rows.append((i, f"http://Host{host}.example/s{section}/{rng.randint(0, n // 2):04d}?q={i}", page))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")


def test_extract_against_brute_force_on_any_partitioning(spark):
    rows = site(random.Random(3), 260) + [(1000 + i, u, p) for i, u, p in site(random.Random(4), 60, marked=True)]
    rows += [(2000 + i, "http://copies.example/same", f"<p>copy</p><div>Foot</div><!-- {i} -->") for i in range(40)]
    rows += [(3000 + i, "http://copies.example/" + "az"[i % 2], f"<p>own {i // 2}</p><div>Foot</div>") for i in range(4)]
    want = brute(rows)
    assert sum("Brand" in t for t in want.values()) == 0 and all(t == "copy" for i, t in want.items() if 2000 <= i < 3000)
    for parts, size in ((1, 2000), (4, 50), (64, 1), (7, 3)):
        got = html.extract(frame(spark, rows).repartition(parts), size).collect()
        assert {r["page_id"]: r["text"] for r in got} == want and len(got) == len(rows)


def test_extract_edges(spark):
    def page(host, body):
        return f"<body><div>{host} menu</div>{body}<div>{host} end</div></body>"

    rows = [(i, f"http://Host{i % 2}/news/{i:03d}?q=1", page(i % 2, f"<p>story {i} of many words</p>")) for i in range(60)]
    rows += [(100, "http://lonely/x", page("l", "<p>alone</p>")), (101, None, "<p>null url</p>"), (102, "http://host1/z", None), (103, "http://host1/zz", "")]
    rows += [rows[5], (None, "http://host0/news/999", page(0, "<p>no id</p>")), (104, None, "<p>null url</p>"), (105, "http://lone/", "<p>menu</p><article>a</article>")]
    got = html.extract(frame(spark, rows), 7).collect()
    of = {}
    for r in got:
        of.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert len(got) == len(rows) and len(of[5]) == 2
    assert all(of[i][0]["text"] == f"story {i} of many words" for i in range(60)) and of[None][0]["text"] == "no id"
    assert of[100][0]["text"] == "l menu\nalone\nl end" and of[101][0]["text"] == of[104][0]["text"] == "null url" and of[102][0]["text"] == of[103][0]["text"] == ""
    assert of[105][0]["text"] == "a"
    assert html.extract(frame(spark, rows).limit(0)).count() == 0


def test_markup_frees_what_is_only_doubtful():
    assert text("<form><main><p>story</p></main></form>") == "story"
    assert text('<div class="search-results-widget"><article>x</article></div>') == "x"
    assert text('<div style="overflow:hidden" title="a hidden gem"><article>x</article></div>') == "x"
    assert text('<div class="content with-sidebar"><article>x</article></div>') == "x"
    assert text('<article>x<p class="share">y</p><h2 id="related-work">z</h2><section id="social-policy">w</section></article>') == "x\ny\nz\nw"
    assert text('<article>x<div class="share-buttons">y</div><p class="ad">z</p><div class="comment">w</div></article>') == "x"
    assert text('<main>x</main><div class="comments"><article class="comment">y</article></div><aside><article>z</article></aside><div hidden><main>w</main></div>') == "x"
    assert text("<form><p>long story</p></form>") == "long story"  # a page that is all form
    assert text("<form>Search</form><article>x</article>", "<p>other</p>") == "x"


def test_alignment_decides_outside_the_article():
    page = lambda n: f"<div>Brand</div><h1>Title {n}</h1><article><p>same words</p><p>text {n}</p></article><div>Foot</div>"
    assert text(page(1), page(2)) == "Title 1\nsame words\ntext 1"


def test_pages_without_article_tags(spark, data):
    """The pages of sf0.01 with the tags of articles taken away: differencing and the marks of other elements decide."""
    pages = [(r["page_id"], r["url"], re.sub("</?article>", "", r["html"])) for r in spark.read.parquet(f"{data}/sf0.01/pages.parquet").collect()]
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, pages), 9).collect()}
    of = {}
    for i, url, page in pages:
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", url).groups()
        of.setdefault(host.lower(), []).append((path.encode(), i, html.blocks(page)))
    for pages_of in of.values():
        pages_of.sort(key=lambda p: p[:2])
        for at, (_, i, lines) in enumerate(pages_of):
            near = {x for j in (-2, -1, 1, 2) if 0 <= at + j < len(pages_of) for x, _ in pages_of[at + j][2]}
            kept = got[i].split("\n") if got[i] else []
            assert set(kept) >= {x for x, k in lines if k == 1 and x not in near}  # what no near page has stays
            rest = iter(x for x, k in lines if k == 1)
            assert all(x in rest for x in kept)  # nothing else comes in, and order is kept


def test_query_against_an_independent_reading(spark, data):
    sf = f"{data}/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op6_html_main_text(spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        page = pages[r["page_id"]]
        article = re.search(r"(?s)<article>(.*?)</article>", page["html"])[1]
        parts = (" ".join(escapes.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(x for x in parts if x) and r["url"] == page["url"]
