"""Main text of web pages: line differencing against the pages of the nearest URLs, with markup as arbiter."""

from __future__ import annotations

import bisect
import hashlib
import html
import os.path
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, slices

#: Pages on either side, of other lines than a page's own, that it is held against.
NEAR = 2
#: Pages of one task: at least so many, and more where there would be more than so many tasks.
RANGE_PAGES, MAX_RANGES = 2000, 8192

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes textarea title svg math object canvas audio video select option datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav aside footer menu dialog search".split())
CONTROLS = frozenset("form fieldset button".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption span b i em strong a".split())
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption".split())
# Words of class, id and role attributes that mark what is not the article; those of adverts and of readers'
# comments; those of page headers; and words that only say what kind of box a marked one is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager footer copyright cookie cookies consent gdpr notice notices alert comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "popup modal overlay widget toolbar complementary contentinfo search".split()
)
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments commentlist reply replies respond disqus".split())
TOP_MARKS = frozenset("header masthead topbar branding".split())
BOXES = frozenset("area bar block body box buttons container content form group inner item items left links list main nav panel right section slot text title top bottom unit wrap wrapper".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What an element is: part of the text, doubtful (its class or a form around it), or said to be no part of the article.
FREE, DOUBTFUL, OFF = 0, 1, 2


def _mark(attributes: str, name: str, inside: bool) -> tuple[bool, int]:
    """(role is main, FREE, DOUBTFUL or OFF) by an element's attributes. A class, id or role that is itself a mark, or a mark
    and words for boxes (comments-list), says OFF; one with a mark among its words (with-sidebar) is DOUBTFUL, and
    nothing inside an article. There, elements of running text heed the marks of adverts and comments only."""
    found, marks = FREE, MARKS if inside else MARKS | TOP_MARKS
    if inside and name in PROSE:
        marks = FOREIGN
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            return False, OFF
        if key not in ("class", "id", "role"):
            continue
        for token in "".join(values).lower().split():
            words = {w for w in re.split(r"[^a-z]+", token) if w}
            if key == "role" and token == "main":
                return True, FREE
            if words & marks:
                if words <= marks | BOXES:
                    return False, OFF
                if not inside:
                    found = DOUBTFUL
    return False, found


def _zone(name: str, attributes: str, zone: tuple[bool, int]) -> tuple[bool, int]:
    """(in the article, FREE, DOUBTFUL or OFF) for the inside of an element. An article or main element that doesn't itself
    say otherwise frees what was only doubtful, such as a form or a wrapper around it."""
    inside, state = zone
    if name in ("html", "body"):
        return zone
    main, mark = _mark(attributes, name, inside) if attributes else (False, FREE)
    if state == OFF or mark == OFF:
        return inside, OFF
    if main or name in ("article", "main"):
        return True, FREE
    if name in ASIDE or (name == "header" and not inside):
        return inside, OFF
    if name in CONTROLS:
        return inside, OFF if inside or name == "button" else DOUBTFUL
    return inside, max(state, mark)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The page's blocks of text in order, each with 2 if inside <article> or <main>, 0 if its element says that it is no
    article text, 3 if that is doubtful, 1 elsewhere. Character references are decoded and white space is turned into
    single spaces."""
    page = page or ""
    out: list[tuple[str, int]] = []
    text: dict[int, list[str]] = {0: [], 1: [], 2: [], 3: []}
    stack: list[tuple[str, tuple[bool, int]]] = []
    zone, at = (False, FREE), 0

    def flush() -> None:
        for kind in text:
            if text[kind]:
                line = " ".join(html.unescape("".join(text[kind])).split())
                if line:
                    out.append((line, kind))
                text[kind] = []

    def add(s: str) -> None:
        if s:
            text[{OFF: 0, DOUBTFUL: 3, FREE: 2 if zone[0] else 1}[zone[1]]].append(s)

    while (m := _TAG.search(page, at)) is not None:
        add(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                if end or name in ("script", "style", "title"):
                    at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if closing:
            if name in (n for n, _ in stack):
                while stack:
                    n, zone = stack.pop()
                    if n == name:
                        break
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            if name in CLOSES_P and stack and any(n == "p" for n, _ in stack):
                k = max(i for i, (n, _) in enumerate(stack) if n == "p")
                if not any(n in BLOCK for n, _ in stack[k + 1 :]):
                    zone = stack[k][1]
                    del stack[k:]
            stack.append((name, zone))
            zone = _zone(name, attributes, zone)
    add(page[at:])
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """The places in a of a longest common subsequence of a and b, found with bit vectors."""
    both = set(a) & set(b)
    ia, ib = [i for i, x in enumerate(a) if x in both], [x for x in b if x in both]
    lead = 0
    while lead < min(len(ia), len(ib)) and a[ia[lead]] == ib[lead]:
        lead += 1
    found = set(ia[:lead])
    ia, ib = ia[lead:], ib[lead:]
    where: dict = {}
    for i, k in enumerate(ia):
        where[a[k]] = where.get(a[k], 0) | 1 << i
    full = (1 << len(ia)) - 1
    v, rows = full, []
    for x in ib:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    col, row = len(ia), len(ib)
    while col and row:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                found.add(ia[col])
    return found


def nearest(path: str, others: list[str]) -> list[int]:
    """The order of others by the length of the beginning they share with path; ties keep their order."""
    return sorted(range(len(others)), key=lambda i: -len(os.path.commonprefix([path, others[i]])))


def template_lines(lines: list[str], others: list[list[str]]) -> set[int]:
    """The places of the lines that a page shares with the nearest of ``others`` that is no copy of it.

    Of the others the one that shares the fewest characters shows what is the template's. Another one that has half or more
    of the rest of the page too is a copy of the page (the same article again) and says nothing about the template."""
    found = [common_lines(lines, other) for other in others]
    if not found:
        return set()
    size = [len(x) for x in lines]
    least = min(found, key=lambda f: sum(size[i] for i in f))
    rest = sum(size) - sum(size[i] for i in least)
    return next((f for f in found if f is least or 2 * sum(size[i] for i in f - least) < rest), least)


def main_text(page: list[tuple[str, int]], others: Iterable[list[tuple[str, int]]]) -> str:
    """The article of a page's blocks, by alignment with the blocks of ``others``, nearest first: shared blocks go.

    Markup arbitrates. Blocks inside <article> or <main> stay, since two articles may have a paragraph in common; blocks
    whose element says that they are no article text go although no other page has them. What is doubtful (a form, a
    class with a mark among its words) goes where the page has an <article> or <main>, and is left to the alignment
    elsewhere. With no other page to hold it against (one with the same lines is none), a page that has an <article> or
    <main> is that alone."""
    named = any(k == 2 for _, k in page)
    open_ = (1,) if named else (1, 3)
    if not any(k in open_ for _, k in page):
        return "\n".join(x for x, k in page if k == 2)
    lines = [x for x, _ in page]
    others = [other for other in ([x for x, _ in o] for o in others) if other != lines]
    shared = template_lines(lines, others)
    free = () if named and not others else open_
    return "\n".join(x for i, (x, k) in enumerate(page) if k == 2 or (k in free and i not in shared))


class _Recent:
    """The last pages of a host in the order they came, one for each list of lines, as many as any page's NEAR others need."""

    def __init__(self):
        self.host, self.pages = None, []

    def add(self, host, digest, page) -> None:
        if host != self.host:
            self.host, self.pages = host, []
        self.pages = [(digest, page), *(x for x in self.pages if x[0] != digest)][: NEAR + 1]

    def near(self, host, digest) -> list:
        return [x for x in self.pages if x[0] != digest][:NEAR] if host == self.host else []


def _digest(lines: list[tuple[str, int]]) -> int:
    """63 bits of a hash of a page's lines."""
    h = hashlib.blake2b(digest_size=8)
    for line, kind in lines:
        h.update(b"%d %d " % (len(line), kind))
        h.update(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest(), "little") >> 1


_KEY = ("host", "path", "page_id", "digest")


def _order(host, path, page_id, digest) -> tuple:
    """Spark's order of the key (nulls first, strings by bytes)."""
    return host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), (page_id is not None, page_id or 0), digest


def _keys(plain: DataFrame) -> DataFrame:
    """(host, path, page_id, digest) of every page."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "html"):
                digests = [_digest(blocks(h)) for h in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("host"), part.column("path"), part.column("page_id"), pa.array(digests, pa.int64())], names=list(_KEY))

    return plain.mapInArrow(rows, "host string, path string, page_id long, digest long")


def _ends(keys: DataFrame, ranges: int) -> list[tuple]:
    """The pages in order of the key, cut into ranges. For each range, in order: its first key, whether it is all of one
    host, and the first and the last pages of other lines each of its first and of its last host. A few rows a range."""

    def rows(batches):
        import pyarrow as pa

        opening, closing, first, number = None, _Recent(), None, None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column("range")[0].as_py()
            for host, path, page, digest in zip(*(batch.column(c).to_pylist() for c in _KEY), strict=True):
                key = (host, path, page, digest)
                if first is None:
                    first, opening = key, []
                if host == first[0] and len(opening) <= NEAR and all(k[3] != digest for k in opening):
                    opening.append(key)
                closing.add(host, digest, key)
        if first is not None:
            one = closing.host == first[0]
            out = [(number, 0, 0, one, first), *((number, 1, i, one, k) for i, k in enumerate(opening)), *((number, 2, i, one, p) for i, (_, p) in enumerate(closing.pages))]
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.record_batch([*columns, *(pa.array([r[4][i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64())))], names=["range", "kind", "place", "one", *_KEY])

    dealt = keys.repartitionByRange(ranges, *_KEY).sortWithinPartitions(*_KEY).withColumn("range", F.spark_partition_id())
    got = dealt.mapInArrow(rows, "range int, kind int, place int, one boolean, host string, path string, page_id long, digest long").collect()
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["range"], r["kind"], r["place"])):
        by.setdefault(r["range"], []).append(r)
    out = []
    for _, part in sorted(by.items()):
        keys_of = [[tuple(r[c] for c in _KEY) for r in part if r["kind"] == k] for k in (0, 1, 2)]
        out.append((keys_of[0][0], part[0]["one"], keys_of[1], keys_of[2]))
    return out


def _borders(ends: list[tuple]) -> list[set[tuple]]:
    """For each range the keys of the pages outside that its own may be held against."""
    wanted: list[set[tuple]] = [set() for _ in ends]
    for forward in (True, False):
        recent = _Recent()
        for i in range(len(ends)) if forward else reversed(range(len(ends))):
            first, one, opening, closing = ends[i]
            head, tail = (opening, closing) if forward else (closing, opening)
            if recent.host == head[0][0]:
                wanted[i].update(k for _, k in recent.pages)
            if not one:
                recent = _Recent()
            for k in reversed(tail):
                recent.add(k[0], k[3], k)
    return wanted


def extract(pages: DataFrame, range_pages: int = RANGE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The pages of a host are laid out by URL path (ties by page_id, then by their lines). Each is held against the NEAR
    pages before it and the NEAR behind it that have other lines than its own, the one that shares most of the path first.
    Runs of exact copies count as one page, however long.

    Pages are dealt by ranges of this order, so that a host of any size is spread over many tasks. The order is found on keys
    alone; a range also gets those few pages outside that its own are held against. So the result doesn't depend on how
    rows are partitioned. The driver sees a few keys a range; a task holds a page and its neighbours at a time.

    Null or empty html: an empty text. Null url: a host of its own, whose pages aren't held against each other. Repeated
    rows each give a row; other columns are ignored. Text is never cut; nothing but the blocks described at main_text() is
    dropped. An empty table gives no rows."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    keys = Table(_keys(plain), "page-keys")
    n = keys.df.count()
    ends = _ends(keys.df, max(1, min(MAX_RANGES, -(-n // range_pages))))
    keys.drop()
    wanted = _borders(ends)
    starts = [_order(*first) for first, *_ in ends]
    schema = "range int, beside boolean, host string, path string, page_id long, url string, digest long, lines array<string>, kinds array<int>"
    borders = [(i, *k) for i, found in enumerate(wanted) for k in found]

    def parsed(find):
        """Rows of schema, one for each range that find(key) gives."""

        def rows(batches):
            import pyarrow as pa

            types = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            names = [c.split()[0] for c in schema.split(", ")]
            for batch in batches:
                for part in slices(batch, "html"):
                    out = []
                    for host, path, page, u, h in zip(*(part.column(c).to_pylist() for c in ("host", "path", "page_id", "url", "html")), strict=True):
                        got = blocks(h)
                        digest = _digest(got)
                        for number, beside in find((host, path, page, digest)):
                            out.append((number, beside, host, path, page, u, digest, [x for x, _ in got], [k for _, k in got]))
                    if out:
                        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

        return rows

    def own(key):
        return ((max(0, bisect.bisect_right(starts, _order(*key)) - 1), False),)

    dealt = plain.mapInArrow(parsed(own), schema)
    if borders:
        ranges_of: dict[tuple, list] = {}
        for i, *k in borders:
            ranges_of.setdefault(tuple(k), []).append((i, True))
        # the ids alone go into the plan; pages with another key of the same id are left out by parsed()
        some = F.broadcast(spark.createDataFrame(sorted({(k[1], k[2], k[3]) for k in borders}, key=repr), "host string, path string, page_id long"))
        near = plain.join(some, [plain[c].eqNullSafe(some[c]) for c in ("host", "path", "page_id")], "left_semi")
        found = near.mapInArrow(parsed(lambda key: ranges_of.get(key, ())), schema)
        found = found.groupBy("range", "host", "path", "page_id", "digest").agg(*(F.first(c).alias(c) for c in ("beside", "url", "lines", "kinds")))
        dealt = dealt.unionByName(found)
    if not ends:
        return spark.createDataFrame([], "page_id long, url string, text string, n_chars long")
    laid = dealt.repartition(len(ends), "range").sortWithinPartitions("range", *_KEY, "beside")
    return laid.mapInArrow(_held_against_neighbours, "page_id long, url string, text string, n_chars long")


def _held_against_neighbours(batches: Iterable) -> Iterator:
    """The text of each page of ranges, which come whole and in order."""
    import pyarrow as pa

    out: list[tuple] = []

    def emit():
        nonlocal out
        got, out = out, []
        return pa.record_batch([pa.array([r[i] for r in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "url", "text", "n_chars"])

    def finish(items):
        for page, u, path, lines, before, after in items:
            others = [x for _, x in before] + [x for _, x in after]
            beside = nearest(path, [p for p, _ in others])
            text = main_text(lines, [others[i][1] for i in beside])
            out.append((page, u, text, len(text)))

    # pages that wait for those behind them, together as long as these have the same lines: {(digest, digests seen): pages}
    recent, waiting, at = _Recent(), {}, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            for number, beside, host, path, page, u, digest, texts, kinds in zip(*(c.to_pylist() for c in part.columns), strict=True):
                lines = list(zip(texts, kinds, strict=True))
                if (number, host) != at:
                    for items in waiting.values():
                        finish(items)
                    recent, waiting, at = _Recent(), {}, (number, host)
                if host:
                    moved: dict = {}
                    for (own, seen), items in waiting.items():
                        if digest != own and digest not in seen:
                            for item in items:
                                item[5].append((digest, (path, lines)))
                            seen = (*seen, digest)
                        if len(seen) == NEAR:
                            finish(items)
                        else:
                            moved.setdefault((own, seen), []).extend(items)
                    waiting = moved
                if not beside:
                    item = (page, u, path, lines, recent.near(host, digest), [])
                    if host and any(k in (1, 3) for k in kinds):
                        waiting.setdefault((digest, ()), []).append(item)
                    else:
                        finish([item])
                if host:
                    recent.add(host, digest, (path, lines))
            if len(out) >= 512:
                yield emit()
    for items in waiting.values():
        finish(items)
    if out:
        yield emit()
