import math
import random

import numpy as np
import pytest

from trellis.llm import vectors
from trellis.llm.queries import op1_exact_top_k, op8_one_bit_codes
from tests.compare import connection, rows as table_rows
from trellis.llm import queries as q


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")


def brute(rows, asked, k, measure):
    out = set()
    for qi, qv in asked:
        s = sorted(((-measure(qv, v), i) for i, v in rows if i != qi and len(v) == len(qv)), key=lambda x: x)[:k]
        out |= {(qi, n + 1, i, -m) for n, (m, i) in enumerate(s)}
    return out


def dot(a, b):
    return int(sum(x * y for x, y in zip(a, b, strict=True)))


def test_exact_top_k(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-9, 9)) for _ in range(6)]) for i in range(1200)]
    rows += [(5000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(7000 + i, [float(i), 2.0]) for i in range(4)]  # few of another length
    bad = [(9000, None), (9001, []), (9002, [1.0, None]), (9003, [float("nan")] * 6), (9004, [float("inf")] * 6), (None, rows[0][1])]
    df = frame(spark, rows + bad)
    asked = [r for r in rows if r[0] % 50 == 0]
    want = brute(rows, asked, 5, dot)
    for size in (8192, 40):
        monkeypatch.setattr(vectors, "SHARD_ROWS", size)
        monkeypatch.setattr(vectors, "QUERY_ROWS", 9 if size == 40 else 1024)
        got = vectors.top_k_inner_product(df, df.where("vec_id % 50 = 0"), 5)
        assert {tuple(r) for r in got.collect()} == want
    assert vectors.top_k_inner_product(df.limit(0), df.limit(0)).count() == 0


def test_large_integers_stay_exact(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**31, 3.0]), (2, [2.0**31, 4.0])]
    got = vectors.top_k_inner_product(frame(spark, rows), frame(spark, rows[:1]), 5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 2**61 + 4), (0, 2, 1, 2**61 + 3)]


def test_ball_tree_bounds():
    x = np.random.default_rng(1).normal(size=(1000, 8))
    order, levels = vectors.ball_tree(x)
    assert sorted(order.tolist()) == list(range(1000))
    for c, r, lo, hi in levels:
        assert lo[0] == 0 and hi[-1] == 1000
        for k in range(len(c)):
            assert (np.sqrt(((x[order[lo[k] : hi[k]]] - c[k]) ** 2).sum(1)) <= r[k] + 1e-12).all()


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_nearest_by_codes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + 0.6 * rng.normal(size=32)).tolist()) for i in range(1500)]
    rows += [(3000 + i, rows[7][1]) for i in range(8)]
    bad = [(9000, None), (9002, [1.0, None]), (9003, [float("nan")] * 32), (9005, [0.0] * 32)]
    df = frame(spark, rows + bad)
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5, cosine)
    for size in (8192, 400):
        monkeypatch.setattr(vectors, "SHARD_ROWS", size)
        got = vectors.nearest_by_codes(df, df.where("vec_id % 50 = 0"), 5).collect()
        assert len(got) == len(want)
        pairs = {(a, c) for a, _, c, _ in want}
        assert sum((r["query_id"], r["vec_id"]) in pairs for r in got) >= 0.97 * len(want)
        of = dict(rows)
        assert all(abs(r["score"] - cosine(of[r["query_id"]], of[r["vec_id"]])) < 1e-12 for r in got)
    assert vectors.nearest_by_codes(df.limit(0), df.limit(0)).count() == 0


def test_codes_are_packed_bits_with_a_scalar():
    rng = np.random.default_rng(3)
    for dim in (64, 70):
        x = rng.normal(size=(50, dim))
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        bits, correction = vectors.encode_bits(x)
        assert bits.shape == (50, -(-dim // 64)) and bits.dtype == np.uint64 and ((correction > 0.6) & (correction <= 1)).all()
        r = vectors.rotation(dim)
        assert np.allclose(r @ r.T, np.eye(dim))
        code = (np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=dim) * 2.0 - 1) / math.sqrt(dim)
        assert np.allclose((code * (unit @ r.T)).sum(1), correction)
        turned = unit[7] @ r.T  # bit counts give the products of the codes with the rounded query
        low, step, planes, lost = vectors.query_planes(turned)
        level = sum(np.unpackbits(p.view(np.uint8), bitorder="little", count=dim).astype(int) << j for j, p in enumerate(planes))
        rounded = low + step * level
        assert np.abs(rounded - turned).max() <= step / 2 + 1e-12 and abs(lost - np.sqrt(((rounded - turned) ** 2).sum())) < 1e-12
        ones = np.bitwise_count(bits).sum(1)
        got = vectors.estimates(bits, ones, 1 / (math.sqrt(dim) * correction), (low, step, planes, lost, rounded.sum()))
        assert np.allclose(got, code @ rounded / correction)
        assert np.abs(got - unit @ unit[7]).max() < 5 / math.sqrt(dim)


def test_very_small_and_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e-200, 0.0]), (2, [1e-200, 1e-200]), (3, [1e200, -1e200]), (4, [5e-324, 0.0]), (50, [1e-300, 0.0])]
    got = vectors.nearest_by_codes(frame(spark, rows), frame(spark, [rows[0], rows[5]]), 5).collect()
    assert len(got) == 10
    of = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert abs(of[0, 2] - 1) < 1e-15 and abs(of[0, 1] - math.sqrt(0.5)) < 1e-15 and abs(of[0, 3]) < 1e-15 and of[50, 1] == of[50, 4] == 1


def test_products_beyond_64_bits_are_refused(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**22, 3.0]), (2, [-(2.0**22), 5.0])]
    got = vectors.top_k_inner_product(frame(spark, rows), frame(spark, rows[:1]), 5).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2**62 + 3), (0, 2, 2, -(2**62) + 5)]
    far = frame(spark, [(0, [1e30]), (1, [2.0])])
    with pytest.raises(Exception, match="64 bits"):
        vectors.top_k_inner_product(far, far, 5).collect()


def test_repeated_ids_spread_and_ask_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 50)
    rows = [(0, [float(i % 7), 1.0]) for i in range(400)] + [(1, [3.0, 2.0]), (2, [1.0, 1.0])]
    for search, measure in ((vectors.top_k_inner_product, dot), (vectors.nearest_by_codes, cosine)):
        got = {(r["query_id"], r["rank"], r["vec_id"]) for r in search(frame(spark, rows), frame(spark, rows), 3).collect()}
        want = {(a, b, c) for a, b, c, _ in brute(rows, [(0, [0.0, 1.0]), *rows[400:]], 3, measure)}
        assert got == want


def test_queries(spark, data):
    sf = f"{data}/sf0.01"
    got = op1_exact_top_k(spark, sf).toPandas()
    assert table_rows(got) == table_rows(connection(sf).execute(q.OP1_SQL).df())
    vs = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(vs, [v for v in vs if v[0] % 50 == 0], 5, cosine)
    near = op8_one_bit_codes(spark, sf).collect()
    exact = {(a, c): m for a, _, c, m in want}
    assert sum((r["query_id"], r["vec_id"]) in exact for r in near) >= 0.9 * len(want)
    of, by = dict(vs), {}
    for r in near:
        assert abs(r["score"] - cosine(of[r["query_id"]], of[r["vec_id"]])) < 1e-12 and r["query_id"] != r["vec_id"]
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == [i for i, _ in vs if i % 50 == 0]
    for rows in by.values():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
