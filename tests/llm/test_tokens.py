import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from trellis.llm import packing, tokens
from trellis.llm.queries import op2_best_fit_packing, op5_token_id_files, tokenizer

ALPHABET = "aAbéÉßñÑİıΣσς  \t\n\x1c\x85\xa0 .,!'\"s't're123²¼_-*$|<>中文й́éǅŉ😀ﬁ٣"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_the_encoder_gives_the_librarys_ids(library):
    rng, enc = random.Random(5), tokens.Encoder(tokenizer(), keep=500)
    assert enc.by_words
    for i in range(6000):
        s = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        if i % 2:
            s = " ".join("".join(rng.choice("abcdeéß'") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "***", "'s", "!!", ", ", "_"]) for _ in range(6))
        ids = library(s)
        assert enc.encode(s) == struct.pack(f"<{len(ids)}I", *ids), s
    long = "ab" * 3000 + " " + "é" * 500
    assert enc.encode(long) == struct.pack(f"<{len(library(long))}I", *library(long))


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, t = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not enc.by_words
    assert enc.encode("A b  c") == struct.pack("<%dI" % len(i := t.encode("A b  c").ids), *i)


ROWS = [(5, "Hello there, world"), (3, None), (1, ""), (9, "word " * 6000), (7, "a"), (7, "b"), (None, "null id"), (2, "\n\t ")]


def test_token_files_round_trip(docs_of, spark, library):
    out, manifest = tokens.write_token_files(docs_of(ROWS), tokenizer(), seq_len=64, batch_rows=4)
    got = tokens.read_token_files(spark, out, manifest).collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for doc, text in want:
        ids = np.array(library(text) + [2], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    shard = manifest[0][0]
    ids, mask = tokens.sequence(out, shard, 0, batch_rows=4)
    assert len(ids) == 64 and ids.dtype == np.uint16 and not ids.flags.owndata and len(mask) == 64


def test_token_files_of_an_empty_table(docs_of, spark):
    out, manifest = tokens.write_token_files(docs_of([]), tokenizer())
    assert manifest == [] and tokens.read_token_files(spark, out, manifest).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_documents(docs_of, library):
    docs = docs_of([*ROWS, *[(100 + i, "x " * (i % 90)) for i in range(300)]])
    got = packing.pack_documents(docs, tokenizer(), capacity=128, end_id=1).collect()
    n = check_packing(got, 128)
    pieces = {}
    for r in got:
        pieces.setdefault((r["doc_id"], r["start"], r["piece"]), []).append((r["length"], r["ids_crc32"]))
    ids = np.array(library("word " * 6000) + [1], "<u4")
    for k in range(0, len(ids), 128):
        assert pieces[9, k, k // 128] == [(len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes()))]
    assert len(pieces[7, 0, 0]) == 2 and pieces[3, 0, 0] == pieces[1, 0, 0]
    assert n == packing.lower_bound([r["length"] for r in got], 128)


def test_packing_with_exchanges(spark):
    rng = random.Random(1)
    lengths = [rng.choice([37, 51, 64, 88, 100, rng.randint(1, 128)]) for _ in range(4000)]
    df = spark.createDataFrame([(i, n, "keep") for i, n in enumerate(lengths)], "doc_id long, length long, certified string")
    got = packing.pack(df, capacity=128, part_rows=250).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == sorted(enumerate(lengths))
    one = check_packing(got, 128)
    assert packing.lower_bound(lengths, 128) <= one <= 1.01 * len(set(packing.best_fit_decreasing(lengths, 128)[0].tolist())) + 1


def test_bounds_and_best_fit():
    assert packing.lower_bound([], 10) == 0 and packing.lower_bound([6, 6, 6], 10) == 3 and packing.lower_bound([4, 4, 4], 10) == 2
    b, at = packing.best_fit_decreasing([3, 7, 5, 5], 10)
    assert len(set(b.tolist())) == 2 and sorted(at.tolist()) == [0, 0, 5, 7]
    rng = random.Random(2)
    for _ in range(200):
        xs = [rng.randint(1, 20) for _ in range(rng.randint(1, 30))]
        used = len(set(packing.best_fit_decreasing(xs, 20)[0].tolist()))
        assert packing.lower_bound(xs, 20) <= used


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="length must be"):
        packing.pack(spark.createDataFrame([(1, 500)], "doc_id long, length long"), 128).collect()
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long"), 128).count() == 0


def test_queries(spark, data, library):
    sf = f"{data}/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(op5_token_id_files(spark, sf).collect())
    start = 0
    for r in got:
        ids = np.array(library(docs[r["doc_id"]]) + [2], "<u4")
        assert tuple(r)[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    packed = op2_best_fit_packing(spark, sf).collect()
    assert check_packing(packed, 4096) == packing.lower_bound([r["length"] for r in packed], 4096)
    assert {r["doc_id"] for r in packed} == set(docs)
