import itertools
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trellis.llm import mixing
from trellis.llm.queries import op7_pfair_mixing
from trellis.llm.shared import Table


def ideal(units, blocks):
    """{source: service after each slot} of the ideal schedule, by steps from one ending to the next, in fractions."""
    served = {s: Fraction(0) for s, n in blocks.items() if n}
    out = {s: [Fraction(0)] for s in served}
    for _ in range(sum(blocks.values())):
        left = Fraction(1)
        while left:
            live = [s for s in served if served[s] < blocks[s]]
            rate = sum(units[s] for s in live)
            step = min([left, *((blocks[s] - served[s]) * rate / units[s] for s in live)])
            for s in live:
                served[s] += units[s] * step / rate
            left -= step
        for s in served:
            out[s].append(served[s])
    return out


def slots(units, blocks):
    """{source: slot of each block}: for every slot all blocks are looked at; the next one of a source whose ideal service has
    begun before the slot's end goes if its service is the first to end, to a whole slot."""
    service, order = ideal(units, blocks), sorted((s for s in blocks if blocks[s]), key=lambda s: (s is not None, s))
    out = {s: [] for s in blocks}
    begun = {s: [next(t for t, x in enumerate(service[s]) if x > j) - 1 for j in range(blocks[s])] for s in order}
    ended = {s: [next(t for t, x in enumerate(service[s]) if x >= j + 1) for j in range(blocks[s])] for s in order}
    for slot in range(sum(blocks.values())):
        ready = [(ended[s][len(out[s])], i) for i, s in enumerate(order) if len(out[s]) < blocks[s] and begun[s][len(out[s])] <= slot]
        out[order[min(ready)[1]]].append(slot)
    return out


CASES = [([1], [5]), ([1, 1], [9, 2]), ([3, 1], [3, 1]), ([5, 3, 2, 1, 1], [10, 30, 4, 7, 2]), ([100, 7, 7, 1], [40, 30, 2, 1]), (list(range(1, 30)), [3] * 29)]
CASES += [([rng.randint(1, 9) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)]) for rng, n in ((random.Random(i), 1 + i % 6) for i in range(12))]


@pytest.mark.parametrize("units, blocks", CASES)
def test_every_source_is_less_than_one_block_from_its_share_all_along(units, blocks):
    names = [None, *(f"s{i:02d}" for i in range(1, len(units)))]
    units, blocks = dict(zip(names, units, strict=True)), dict(zip(names, blocks, strict=True))
    got, service = mixing.schedule(units, blocks), ideal(units, blocks)
    assert sorted(x for v in got.values() for x in v) == list(range(sum(blocks.values())))
    assert {s: len(v) for s, v in got.items()} == blocks and all(v == sorted(v) for v in got.values())
    for s, path in service.items():
        at = set(got[s])
        given = list(itertools.accumulate((t in at for t in range(len(path) - 1)), initial=0))
        assert all(abs(g - x) < 1 for g, x in zip(given, path, strict=True))
    assert got == slots(units, blocks)


def test_many_sources_take_no_longer_than_their_blocks():
    rng = random.Random(7)
    totals = {f"s{i}": rng.randint(1, 200_000) for i in range(100_000)}
    blocks = {s: -(-t // 32768) for s, t in totals.items()}
    began = time.monotonic()
    got = mixing.schedule(mixing.target_units(totals, None), blocks)
    assert time.monotonic() - began < 30
    assert sorted(x for v in got.values() for x in v) == list(range(sum(blocks.values())))


def test_target_units():
    assert mixing.target_units({"a": 900, "b": 100}, None) == {"a": 768, "b": 256}
    assert mixing.target_units({"a": 1, "b": 1, "c": 1}, {"a": 3, "b": 1}) == {"a": 768, "b": 256, "c": 1}


def brute(rows, weights, block_chars):
    """{doc_id: slot}: each source's texts end to end in the order of their hashes, one by one; ids and texts are different."""
    at, place, totals = {}, {}, {}
    for i, text, source, _ in sorted(rows, key=lambda r: r[3]):
        place[i] = totals.get(source, 0)
        totals[source] = place[i] + max(1, len(text or ""))
    blocks = {s: -(-t // block_chars) for s, t in totals.items()}
    raw = {s: max(0, weights.get(s, 0)) if weights else t**0.5 for s, t in totals.items()}
    scale = 1 << (max(1024, sum(totals.values()) * max(1, len(totals) // 64)) - 1).bit_length()
    at = slots({s: max(1, round(scale * r / sum(raw.values()))) for s, r in raw.items()}, blocks)
    return {i: at[source][place[i] // block_chars] for i, _, source, _ in rows}


def with_hashes(docs):
    """The order inside a source is that of a public hash function of id and text, read as an unsigned bucket and a signed rest."""
    h = F.xxhash64(F.lit(3), F.col("doc_id"), F.col("text"), F.lit(0))
    return h.alias("h")


def test_rows_get_the_slots_of_their_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "x" * rng.randint(1, 90), "y" * 700]), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(400)]
    rows.append((1000, "only", "single"))
    docs = docs_of(rows)
    got = mixing.mix(docs.withColumnRenamed("lang", "mix_slot"), {"hot": 1, "a": 2, "single": 1}, block_chars=100).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    of = {i: (text, source) for i, text, source in rows}
    for source in ("hot", "a", "b", None, "single"):  # places of a source are laid end to end
        mine = sorted((r["mix_place"], max(1, len(of[r["doc_id"]][0] or ""))) for r in got if r["source"] == source)
        at = 0
        for place, size in mine:
            assert place == at
            at += size
    buckets = -(-len(rows) // 7)
    hashes = {r["doc_id"]: (((r["h"] % 2**64) >> 44) * buckets >> 20, r["h"], r["doc_id"]) for r in docs.select("doc_id", with_hashes(docs)).collect()}
    assert {r["doc_id"]: r["mix_slot"] for r in got} == brute([(*r, hashes[r[0]]) for r in rows], {"hot": 1, "a": 2, "single": 1}, 100)


def test_edges(docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and "mix_slot" in mixing.mix(docs_of([])).columns
    same = mixing.mix(docs_of([(1, "a", "s"), (1, "a", "s"), (None, "b", None)])).collect()
    assert len(same) == 3 and all(r["mix_slot"] is not None for r in same)
    ordered = mixing.in_order(docs_of([(i, "x" * 50, "ab"[i % 2]) for i in range(40)]), block_chars=100)
    assert ordered.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"] and ordered.count() == 40


def test_the_main_path_runs_no_python(spark, data):
    plan = op7_pfair_mixing(spark, f"{data}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_against_brute_force(spark, data):
    sf = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    buckets = -(-docs.count() // mixing.BUCKET_ROWS)
    rows = [(r["doc_id"], r["text"], r["source"], (((r["h"] % 2**64) >> 44) * buckets >> 20, r["h"], r["doc_id"])) for r in docs.select("doc_id", "text", "source", with_hashes(docs)).collect()]
    got = op7_pfair_mixing(spark, sf).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["slot"] for r in got} == brute(rows, None, 32768)


def test_rows_without_an_id_or_with_the_same_spread(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    for rows in ([(None, f"text {i}", "s") for i in range(2000)], [(7, "same", "s")] * 2000):
        kept = []
        monkeypatch.setattr(mixing, "Table", lambda df, *a: kept.append(Table(df, *a)) or kept[-1])
        got = mixing.mix(docs_of(rows), block_chars=100)
        assert sorted(r["mix_place"] for r in got.collect()) == list(itertools.accumulate([0] + [len(r[1]) for r in rows[:-1]])) or len({len(r[1]) for r in rows}) > 1
        assert got.select("mix_place").distinct().count() == 2000
        sums = [t.df for t in kept if "n" in t.df.columns and "bucket" in t.df.columns][-1]
        assert sums.count() > 20 and sums.agg(F.max("n")).first()[0] < 150


@pytest.mark.parametrize("weights", [{"hot": 0.5}, {"hot": 0.3996, "rare": 0.0004}])
def test_target_weights_hold_with_many_sources_and_small_weights(weights):
    n = 5000 if "rare" not in weights else 40
    others = [f"s{i}" for i in range(n)]
    weights = {**weights, **{s: (1 - sum(weights.values())) / n for s in others}}
    totals = {s: 1 << 20 if s in others else 1 << 30 for s in weights}
    units = mixing.target_units(totals, weights)
    blocks = sum(-(-t // 32768) for t in totals.values())
    assert all(abs(u / sum(units.values()) - weights[s]) * blocks < 0.01 for s, u in units.items())


def test_a_schedule_keeps_real_weights_to_a_block():
    weights = {"a": 0.7, "b": 0.2995, "rare": 0.0005}
    totals = {s: round(32768 * 20000 * w) for s, w in weights.items()}
    blocks = {s: -(-t // 32768) for s, t in totals.items()}
    got = mixing.schedule(mixing.target_units(totals, weights), blocks)
    end = min(v[-1] for v in got.values())
    for s, v in got.items():
        assert all(abs(k - weights[s] * x) < 1.01 and abs(k + 1 - weights[s] * (x + 1)) < 1.01 for k, x in enumerate(v) if x <= end)
    rows = list(mixing.grouped(got))
    assert {s: [x for t, _, part in rows if t == s for x in part] for s in totals} == got
