import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import near_duplicates, shingles
from trellis.llm import dedup
from trellis.llm.components import components
from trellis.llm.queries import op3_minhash_near_dedup
from trellis.llm.shingles import set_hash, shingle_sets, signatures


def run(docs):
    return sorted(map(tuple, dedup.near_duplicates(docs, percent=85).collect()), key=repr)


def same(docs_of, rows):
    assert run(docs_of(rows)) == sorted(near_duplicates(rows), key=repr)


def words(rng, n, vocabulary=5000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def test_shingle_hashes_agree_with_shingles():
    rng = random.Random(4)
    texts = ["", None, "one", "A b C", "a B c", "a\x0bb\x0cc d e f", "ä Ä é\x85x y z", "x" * 3000 + " y z u v w", " ".join(words(rng, 4000)), "a  b\n\nc\td e\r\nf "]
    texts += ["".join(rng.choice("abAB \t\né") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for arr in (pa.array(texts), pa.array(["q", *texts]).slice(1), pa.array(texts, pa.large_string())):
        got = shingle_sets(arr)
        want = [shingles(t) for t in texts]
        assert [len(s) for s in got] == [len(s) for s in want]
        by = {}
        for h, s in zip(set_hash(got).tolist(), want, strict=True):
            assert by.setdefault(h, s) == s
        assert len(by) == len(set(want))


def test_signatures_estimate_similarity():
    rng = random.Random(6)
    a = words(rng, 600)
    sets = shingle_sets(pa.array([" ".join(a), " ".join(edited(rng, a, 12)), " ".join(words(rng, 600))]))
    sig = signatures(sets, 384)
    j = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs((sig[0] == sig[1]).mean() - j) < 0.08 and (sig[0] == sig[2]).mean() < 0.03


def test_least_matches_keep_true_pairs():
    need = dedup.least_matches(0.85, [64, 384], 1e-7)
    rng = np.random.default_rng(0)
    assert (rng.binomial(64, 0.8506, 10**6) < need[0]).mean() < 1e-5 and need[1] > 280


def test_edge_cases(docs_of):
    rows = [(4, None), (1, ""), (2, "  \n"), (8, "one two"), (7, "One  TWO"), (6, "one two three"), (5, "a b c d e"), (3, "A b\nc d e"), (None, "a b c d e"), (None, "alone here"), (9, "x y"), (9, "x y"), (9, "other words")]
    same(docs_of, rows)
    assert dedup.near_duplicates(docs_of([])).count() == 0
    kept = dedup.drop_near_duplicates(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, ""), (2, "  \n"), (3, "A b\nc d e"), (4, None), (6, "one two three"), (7, "One  TWO"), (9, "x y"), (9, "other words"), (None, "alone here")], key=repr)
    assert dedup.drop_near_duplicates(docs_of([])).count() == 0
    nulls = dedup.drop_near_duplicates(docs_of([(None, "p q r s t")] * 5 + [(None, None)] * 2).withColumnRenamed("lang", "component_id"))
    assert sorted(str(r["text"]) for r in nulls.collect()) == ["None", "None", "p q r s t"]


def test_thresholds_and_chains(docs_of):
    rng = random.Random(8)
    rows, at = [], 0
    for n in (20, 60, 200, 900):
        base = words(rng, n)
        for k in (0, 1, 2, 4, 8, 16):
            rows.append((at, " ".join(edited(rng, base, k * n // 200))))
            at += 1
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, max(1, n // 100))
            rows.append((at, " ".join(chain)))
            at += 1
    rng.shuffle(rows)
    same(docs_of, rows)


def test_hot_groups(docs_of, monkeypatch):
    rng = random.Random(9)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6])))) for i in range(700)]
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    rows += [(1500 + i, " ".join(edited(rng, words(random.Random(1), 150), rng.choice([1, 2, 3])))) for i in range(900)]
    rows += [(2000 + i + 1000, "the same long line of boilerplate words here " + " ".join(words(rng, 20))) for i in range(200)]
    same(docs_of, rows)


@pytest.mark.parametrize("wide", [0, 4])
def test_buckets_of_many_blocks(docs_of, monkeypatch, wide):
    for name, value in (("BLOCK", 40), ("SHARED", 4), ("HOT", 8), ("WIDE", wide)):
        monkeypatch.setattr(dedup, name, value)
    rng = random.Random(10)
    base = words(rng, 150)
    rows = []
    for i in range(500):
        one = edited(rng, base, 4)
        rows.append((2 * i, " ".join(one)))
        if i % 5 == 0:  # a partner of its own, in any block
            rows.append((2 * i + 1, " ".join(edited(rng, one, 1))))
    same(docs_of, rows)


def test_texts_of_one_template_are_dealt_in_proportion(docs_of, monkeypatch):
    """Alike, but most of them not similar enough, with shingles that are not their own."""
    monkeypatch.setattr(dedup, "BLOCK", 32)
    dealt = []
    compared = dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda rows, *rest: dealt.append((rest[-1], rows.count())) or compared(rows, *rest))
    rng = random.Random(12)
    base, totals = words(rng, 220), []
    for n in (800, 1600):
        # a passage comes in about six texts, whatever n
        passages = [words(rng, 10) for _ in range(n // 2)]
        rows = []
        for i in range(n):
            body = base[:60] + sum(rng.sample(passages, 3), []) + base[60:]
            rows.append((2 * i, " ".join(body)))
            if i % 20 == 0:
                rows.append((2 * i + 1, " ".join(edited(rng, body, 1))))
        dealt.clear()
        same(docs_of, rows)
        totals.append(sum(k for _, k in dealt))
        assert any(not banded for banded, _ in dealt)
    assert totals[1] < 2.4 * totals[0]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 500 + i) for i in range(1, 80)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    up = {}

    def root(v):
        while up.get(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, data):
    sf = f"{data}/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op3_minhash_near_dedup(spark, sf).collect()))
    assert got == sorted(near_duplicates(rows))


@pytest.mark.parametrize("percent", [30, 50, 70, 80, 85, 95])
def test_bands_miss_hardly_a_pair_at_the_threshold(percent):
    n, places = dedup.bands(percent)
    assert n <= 64 and n % 8 == 0 and (1 - (percent / 100) ** places) ** n <= 3e-7


def test_the_stage_takes_a_similarity_of_four_fifths(spark, docs_of):
    import corpus_pipeline

    rng = random.Random(11)
    rows = []
    for i in range(60):  # 204 words: 2 edits far from each other leave (200 - 10) / (200 + 10) = 0.905, 4 leave 0.818
        base = words(rng, 204)
        rows.append((2 * i, " ".join(base)))
        for at in (10, 60, 110, 160)[: 2 if i % 3 else 4]:
            base[at] = f"e{i}x{at}"
        rows.append((2 * i + 1, " ".join(base)))
    want = sorted(r[0] for r in near_duplicates(rows, 80) if r[3])
    assert want == list(range(0, 120, 2)) and len([r for r in near_duplicates(rows, 85) if r[3]]) == 80
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), "").collect()) == want


def test_words_that_collide_under_polynomial_hashes_do_not_here():
    a, b = "a", "b"
    for _ in range(12):  # Thue-Morse words: equal modulo 2**64 for any odd multiplier
        a, b = a + b, b + a
    rows = pa.array([a, b, "x" * 64, "x" * 65, "X" * 65, "x" * 8, "x" * 9])
    for key in (0, 12345, 2**64 - 1):
        got = [int(s[0]) for s in shingle_sets(rows, key)]
        assert len(set(got)) == 6 and got[3] == got[4]
    assert shingle_sets(rows, 1)[5][0] != shingle_sets(rows, 2)[5][0]
