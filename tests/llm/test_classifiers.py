import bisect
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from trellis.llm import labelled, quality, toxicity
from trellis.llm.queries import op4_attention_quality, op10_boosted_toxicity
from trellis.llm.trees import Boosted, Isotonic

CALM = "the river and house over green hill walking slowly with friends toward evening light under tall trees".split()
RUDE = ["wretchling", "dunderhead", "vilecreep"]


def documents(rng, n):
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(CALM) + rng.choice(["", "", "ing", "s"]) for _ in range(rng.randint(5, 300))]
        toxic, bad = rng.random() < 0.25, rng.random() < 0.3
        if toxic:
            for _ in range(max(1, len(w) // 40)):
                k = rng.randrange(len(w))
                w[k : k + 1] = ["you", rng.choice(RUDE) + "!"]
        if bad:
            at = rng.randrange(len(w))
            w[at:] = [x + "###" for x in w[at:]] or ["###"]
            w += ["$$$ | %%%"] * 30
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark, docs_of):
    rows, labels = documents(random.Random(12), 900)
    return docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


EDGES = [(1, None), (2, ""), (3, " \n "), (4, "!!!"), (5, "word " * 100000), (5, "again"), (None, "null id"), (6, "x" * 100000)]


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy_and_edges(spark, docs_of, corpus, module, column):
    docs, labels, truth = corpus
    model = module.fit(docs, labels.where("doc_id % 3 > 0"))
    got = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    held = [t for t in truth if t[0] % 3 == 0]
    right = sum((got[t[0]] >= 0.5) == bool(t[1 if column == "quality" else 2]) for t in held)
    assert right >= 0.96 * len(held)
    edge = module.score(docs_of(EDGES), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edge)
    blank = {round(r["score"], 12) for r in edge if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert module.score(docs_of([]), model).count() == 0
    select = module.keep_good if column == "quality" else module.keep_clean
    kept = select(docs, model, 0.5)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if (s >= 0.5) == (column == "quality")}
    assert select(docs_of([]), model, 0.5).count() == 0
    scores = module.score(docs_of(EDGES), model).collect()
    assert select(docs_of(EDGES), model, 0.5).count() == sum((r["score"] >= 0.5) == (column == "quality") for r in scores)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_labels_of_one_kind_or_none(spark, docs_of, module):
    docs = docs_of([(1, "a b c"), (2, "d e f")])
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 0, 0), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.5 for r in module.score(docs, module.fit(docs, one.where("quality = 1 or quality is null"))).collect())
    assert all(r["score"] == 0.5 for r in module.score(docs, module.fit(docs, one.limit(0))).collect())
    assert module.fit(docs_of([]), one).constant == 0.5


def test_obfuscations_and_proximity():
    f = toxicity.Features(frozenset(["idiot", "^vequ"]))
    names = {n: k for k, n in enumerate(toxicity.FEATURES)}
    x = f(["what an 1d!0t. you see", "such an i.d.i.o.t here", "IDIOT IDIOT", "vequance du", "idiooooot", "calm words only", None])
    assert x[0, names["obfuscated"]] > 0 and x[1, names["obfuscated"]] > 0 and x[4, names["obfuscated"]] > 0
    assert x[0, 16] == 1 and x[0, names["second"]] > 0
    assert x[2, names["lexicon"]] == 1 and x[2, names["caps"]] == 1
    assert x[3, names["stem"]] == 0.5 and x[3, names["second"]] == 0.5
    assert not x[5, :8].any() and not x[6].any()


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    t = Boosted().fit(x, y)
    assert ((t.raw(x) > 0) == y).mean() > 0.97
    s = rng.random(400)
    z = (rng.random(400) < s).astype(float)
    c = Isotonic().fit(s, z)
    grid = c(np.linspace(-1, 2, 50))
    assert (np.diff(grid) >= 0).all() and grid[0] > 0 and grid[-1] < 1 and abs(c(0.5) - 0.5) < 0.2


def test_attention_gradients():
    rng = np.random.default_rng(2)
    x, first, y = rng.normal(size=(12, 6)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 1, 0])
    m = quality.Model(hidden=5, gate=3).fit(x, first, y, steps=3)
    weight = np.array([0.3, 0.1, 0.2, 0.4])

    def loss():
        p = m._forward(x, first)[-1]
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    got = m._gradients(x, first, y, weight)
    for name, values in m.p.items():
        for at in np.ndindex(values.shape):
            keep = values[at]
            values[at] = keep + 1e-6
            up = loss()
            values[at] = keep - 1e-6
            down = loss()
            values[at] = keep
            assert abs((up - down) / 2e-6 - got[name][at]) < 1e-6
    m = quality.Model(hidden=5, gate=3).fit(x, first, y, steps=300)
    got = m._forward(np.clip((x - m.mean) / m.scale, -8, 8), first)
    assert np.abs(got[-1] - y).max() < 0.1 and np.allclose(np.add.reduceat(got[4], first), 1)


def kinds_of(word):
    return ["9" if c.isdigit() else "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else c for c in word]


def quality_by_hand(model, text):
    """The score of a text, passage by passage and word by word."""
    words, h, e = (text or "").split(), [], []
    for lo in range(0, max(1, len(words)), 128):
        part = words[lo : lo + 128]
        n = max(1, len(part))
        f = [0.0] * 46
        for w in part:
            k = kinds_of(w)
            run = "".join(c for c, _ in itertools.groupby(k))
            letters, signs = sum(c in "aA" for c in k), sum(c not in "aA9" for c in k)
            f[zlib.crc32(run.encode()) % 32] += 1 / n
            for j, flag in enumerate((not letters, signs > 1, k.count("A") > 1, "9" in k, run[-1] in ".!?", letters > 0 and signs >= letters)):
                f[32 + j] += flag / n
        sizes = [len(w) for w in part]
        mean = sum(sizes) / n
        f[38], f[39] = mean / 10, math.sqrt(max(0, sum(x * x for x in sizes) / n - mean * mean)) / 5
        f[40] = sum(a == b for a, b in zip(part, part[1:])) / n
        f[41], f[42] = len(set(part)) / n, max((part.count(w) for w in set(part)), default=0) / n
        f[43] = math.log1p(len(part)) / 5
        f[44], f[45] = (text or "").count("\n") / max(1, len(words)), math.log1p(len(words)) / 10
        f = [min(8, max(-8, (a - b) / c)) for a, b, c in zip(f, model.mean, model.scale)]
        p = {k: v.tolist() for k, v in model.p.items()}
        h.append([math.tanh(sum(x * r[j] for x, r in zip(f, p["W"])) + p["b"][j]) for j in range(len(p["b"]))])
        dot = lambda m, j: sum(x * r[j] for x, r in zip(h[-1], m))
        e.append(math.exp(sum(w * math.tanh(dot(p["V"], j)) / (1 + math.exp(-dot(p["U"], j))) for j, w in enumerate(p["w"]))))
    z = [sum(a * r[j] for a, r in zip(e, h)) / sum(e) for j in range(len(h[0]))]
    return 1 / (1 + math.exp(-sum(c * x for c, x in zip(p["c"], z)) - p["d"][0]))


def toxicity_by_hand(model, text):
    """The score of a text, word by word and tree by tree."""
    x, words = [0.0] * 24, (text or "").split()
    if words:
        edges = toxicity._EDGES
        marks = []
        for w in words:
            bare, core = w.lower().strip(edges), w.strip(edges)
            begins = lambda v: any(f"^{v[:k]}" in model.lexicon for k in (4, 5) if len(v) >= k)
            lex, stem = bare in model.lexicon, begins(bare)
            mixed = len(core) > 2 and not core.isalpha() and any(map(str.isalpha, core))
            long = any(len(list(g)) > 2 for _, g in itertools.groupby(core))
            f = toxicity.folded(w)
            hidden = not lex and (mixed or long or core != w) and f != bare and (f in model.lexicon or (not stem and begins(f)))
            marks.append((lex, stem, hidden, bare in toxicity.SECOND_PERSON, len(core) > 1 and core.isupper(), mixed, w[-1] in "!?", long))
        for k in range(8):
            c = sum(m[k] for m in marks)
            x[k], x[8 + k] = c / len(words), math.log1p(c)
        hits, you = [i for i, m in enumerate(marks) if any(m[:3])], [i for i, m in enumerate(marks) if m[3]]
        if hits and you:
            gaps = [min(abs(i - j) for j in you) for i in hits]
            x[16], x[17] = sum(g <= 5 for g in gaps) / len(gaps), 1 / (1 + min(gaps))
        x[18], x[19] = len(hits) / len(words), math.log1p(len(hits))
        x[20], x[21], x[22] = text.count("!") / len(text), text.count("?") / len(text), sum(c in "*#@$%&" for c in text) / len(text)
        x[23] = math.log(len(words))
    raw = model.trees.base
    for feature, threshold, value in model.trees.trees:
        at = 0
        while at < 7 and feature[at] >= 0:
            at = 2 * at + 1 + int(x[feature[at]] > threshold[at])
        raw += value[at]
    xs, ys = model.curve.x.tolist(), model.curve.y.tolist()
    k = bisect.bisect_right(xs, raw)
    if k in (0, len(xs)):
        return ys[0 if not k else -1]
    return ys[k - 1] + (ys[k] - ys[k - 1]) * (raw - xs[k - 1]) / (xs[k] - xs[k - 1])


@pytest.mark.parametrize("module, by_hand", [(quality, quality_by_hand), (toxicity, toxicity_by_hand)])
def test_scores_against_a_recomputation_by_hand(spark, docs_of, corpus, data, module, by_hand):
    docs, labels, _ = corpus
    model = module.fit(docs, labels)
    real = [(100000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/sf0.001/documents.parquet").limit(60).collect() if len(r["text"]) < 20000]
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(40).collect()] + real + [(5000 + i, t) for i, (_, t) in enumerate(EDGES[:5] + EDGES[7:])]
    rows.append((9000, "you WRETCHLING! dunder.head v1l3creep vilecreeeeep ¿du?\nx y\n" + "z" * 999))
    got = {r["doc_id"]: r["score"] for r in module.score(docs_of(rows), model).collect()}
    assert all(abs(got[i] - by_hand(model, t)) < 1e-9 for i, t in rows)


def test_every_character_of_a_word_counts():
    assert quality.shape("a" * 300 + "1!") != quality.shape("a" * 302) and quality.shape("ab" * 400) != quality.shape("ab" * 500)


def test_the_lexicon_takes_all_that_qualify(spark):
    rows = [(" ".join(f"{'abcdefghij'[i % 10]}{j}x" for j in range(300)), 1) for i in range(100)] + [("calm words", 0)] * 100
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"), 100, 100)
    assert {w for w in got if w[0] != "^"} == {f"{c}{j}x" for c in "abcdefghij" for j in range(300)}


def test_samples_are_bounded_and_the_same_each_time(spark, docs_of):
    rows = [(i, " ".join(f"{w}{i // 2}" for w in "one two three four five six".split())) for i in range(200)] + [(7, "again and other"), (None, "no id")]
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(200)], "doc_id long, quality int")
    take = lambda parts, **kw: sorted(map(tuple, labelled.sample(docs_of(rows).repartition(parts), labels, "quality", {1: 60, 0: 60}, **kw).df.collect()))
    whole = take(1)
    assert take(5) == take(3) == whole and 80 <= len(whole) <= 120
    assert len({(t, y) for _, t, y in whole}) == len(whole)
    few = take(4, chars=600)
    assert 0 < len(few) < len(whole) and all(sum(len(t) for _, t, v in few if v == y) <= 600 for y in (0, 1))


def test_passages_cover_whole_texts():
    x, first = quality.Passages()(["a b", "", "w " * 300, None])
    assert first.tolist() == [0, 1, 2, 5] and x.shape == (6, quality.WIDTH)
    assert not x[1].any() and not x[5].any()


@pytest.mark.parametrize("query, column, mod, left, threshold", [(op4_attention_quality, "quality", 4, 2, 0.7), (op10_boosted_toxicity, "toxic", 5, 0, 0.5)])
def test_queries(spark, data, query, column, mod, left, threshold):
    sf = f"{data}/sf0.1"
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = query(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == left) and r["predicted"] == int(r["score"] >= threshold)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
