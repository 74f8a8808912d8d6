import sys

import corpus_pipeline
from tests.llm.brute import near_duplicates
from tests.llm.test_tokens import check_packing
from trellis.llm import packing, quality, queries, toxicity


def test_stages_against_brute_force(spark, data):
    sf = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, sf)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, queries.quality_model(spark, docs, sf)).collect()}
    good_ids = {i for i, s in scores.items() if s >= 0.7}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == good_ids
    kept = docs.where(docs.doc_id.isin(sorted(good_ids)))
    clean = corpus_pipeline.keep_clean(spark, kept, sf)
    toxic = {r["doc_id"]: r["score"] for r in toxicity.score(kept, queries.toxicity_model(spark, kept, sf)).collect()}
    clean_ids = {i for i, s in toxic.items() if s < 0.5}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == clean_ids
    unique_ids = {d for d, _, _, k in near_duplicates([(i, rows[i]["text"]) for i in sorted(clean_ids)], 80) if k}
    final = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in final} == unique_ids
    assert check_packing(final, 4096) == packing.lower_bound([r["length"] for r in final], 4096)


def test_empty_documents(spark, data, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_library_does_without_this_subpackage():
    import subprocess

    code = "import sys; sys.modules['trellis.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.llm is None and e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_sequences_follow_the_mixing_schedule(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 256)
    words = "one two three four five six seven eight nine ten ".split()
    rows = [(i, " ".join(words[(i + j) % 10] for j in range(200 + i * 37 % 900)), "a" if i < 2200 else "b" if i < 2900 else "c") for i in range(3000)]
    docs = docs_of(rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, "").cache()
    slot = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixed.select("doc_id", "mix_slot", "mix_place").collect()}
    got = corpus_pipeline.pack_sequences(spark, mixed.repartition(7), "").collect()
    assert sorted({r["doc_id"] for r in got}) == list(range(3000))
    n = check_packing(got, 4096)
    assert n <= 1.01 * packing.lower_bound([r["length"] for r in got], 4096) + 1
    order = sorted(got, key=lambda r: (*slot[r["doc_id"]], r["piece"]))
    dealt = sorted(got, key=lambda r: r["sequence_id"])
    window = 2 * 256 * max(r["length"] for r in got)  # windows are cut by a sample
    source = {i: s for i, _, s in rows}
    at, given, want, total = 0, {}, {}, 0
    for r in dealt:  # any prefix holds what the same prefix of the schedule does, to a window
        s = source[r["doc_id"]]
        given[s], total = given.get(s, 0) + r["length"], total + r["length"]
        while at < len(order) and sum(want.values()) < total:
            s = source[order[at]["doc_id"]]
            want[s], at = want.get(s, 0) + order[at]["length"], at + 1
        assert all(abs(given.get(s, 0) - want.get(s, 0)) < window for s in "abc")
    ranks = {r["doc_id"]: i for i, r in enumerate(order)}
    assert sum(abs(ranks[r["doc_id"]] - i) for i, r in enumerate(dealt)) / len(got) < 256


def test_rows_go_to_the_workers_in_bounded_batches(spark, data):
    limit, sf = "spark.sql.execution.arrow.maxBytesPerBatch", f"{data}/sf0.001"

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    def largest():
        got = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 1 << 20) as text").mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 24
        return max(r["bytes"] for r in got)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    before = spark.conf.get(limit, None)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.unset(limit)
            stage(spark, mixed if name == "packing" else docs, sf)
            assert largest() < 6 << 20, name
        spark.conf.set(limit, "1m")  # a limit of the session's own stays
        corpus_pipeline.mix_sources(spark, docs, sf)
        assert spark.conf.get(limit) == "1m" and largest() < 2 << 20
    finally:
        spark.conf.unset(limit)
        if before is not None:
            spark.conf.set(limit, before)
