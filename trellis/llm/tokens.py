"""Token-ID output: Arrow files of fixed-size-list batches, and the encoder that other operators share."""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, new_path, put_file, slices

#: Unicode white space; str.split() would also split at U+001C..U+001F, which the tokenizer keeps.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"


#: Outside these, lower case or normal form may depend on a library's version or on neighbours.
_RARE = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: What may follow a word of letters as one run of symbols.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """A tokenizer of the tokenizers library, with the ids of words it has seen kept in tables of bounded size.

    If the file's rules drop white space and cut a text into runs of letters, single digits and runs of symbols before
    its model sees them (``by_words``), the ids of a text are those of its words in turn, and those of a word of letters
    with symbols behind it are those of the two parts. The model itself then encodes each new run of letters; anything
    else goes through the whole library. Other tokenizers get every text whole. Ids are little-endian unsigned 32-bit."""

    def __init__(self, path: str, keep: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        pre = json.dumps(rules.get("pre_tokenizer") or {})
        self.by_words = '"Removed"' in pre and '"invert": true' in pre and r"[^\\s\\p{L}\\p{N}]+" in pre and rules["model"].get("type") == "BPE"
        self.vocab = self.tok.get_vocab_size()
        self.keep, self.words, self.runs, self.model = keep, {}, {}, self.tok.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level alphabet: others from 256 on
        hidden = (b for b in range(256) if b not in shown)
        self.alphabet = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        probes = ["the", "\u00e9t\u00e9", "stra\u00dfe", "unbelievably", "\u00f1", "zqxj"]
        if self.by_words and [self._run(p) for p in probes] != self._encode(probes):
            self.by_words = False
        self.runs.clear()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _run(self, letters: str) -> bytes:
        if (ids := self.runs.get(letters)) is None:
            seen = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
            got = [t.id for t in self.model.tokenize(seen)]
            ids = struct.pack(f"<{len(got)}I", *got)
            if len(self.runs) >= self.keep:
                self.runs.clear()
            if len(letters) <= 64:
                self.runs[letters] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if _RARE.search(word):
            ids = self._encode([word])[0]
        else:
            low = word.lower()
            letters = low.rstrip(_TAIL)
            if not letters.isalpha():
                ids = self._encode([low])[0]
            elif len(letters) == len(low):
                return self._run(low)
            else:
                tail = low[len(letters) :]
                if (end := self.words.get(tail)) is None:
                    end = self._encode([tail])[0]
                    if len(tail) <= 64:
                        self.words[tail] = end
                ids = self._run(letters) + end
        if len(self.words) >= self.keep:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids; a null text has none."""
        if not text:
            return b""
        if not self.by_words:
            return self._encode([text])[0]
        plain = not _RARE.search(text)
        text = text.lower() if plain else text
        parts = _SPACE.split(text) if any(c in text for c in _SEPARATORS) else text.split()
        words, runs, word = self.words, self.runs, self._word
        return b"".join([runs.get(w) or words.get(w) or word(w) for w in parts if w])


def encoded(batches: Iterable, path: str, end_id: int | None):
    """(slice of the batch, list of its texts' id bytes) for every batch with a text column."""
    enc = Encoder(path)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, [enc.encode(t) + end for t in part.column("text").to_pylist()]


def _id_type(vocab: int):
    import numpy as np

    return np.dtype("<u2") if vocab <= 1 << 16 else np.dtype("<u4")


def write_token_files(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2, seq_len: int = 1024, batch_rows: int = 256) -> tuple[str, list[tuple[int, int, int]]]:
    """Encode every text and write the ids, in ascending doc_id order, as Arrow files.

    Each file holds batches of ``batch_rows`` sequences of exactly ``seq_len`` ids (column ``tokens``) with a mask of
    valid places (column ``mask``), both fixed-size lists without compression, so that a memory map gives any sequence
    without a copy; only a file's last sequence is padded. ``*.index.arrow`` beside it has (doc_id, n_tokens) in order.
    Files are dealt by ranges of doc_id; the number in a file's name is the order of the ranges. A file appears under
    its name only when complete, and a repeated task writes the same bytes again.

    Returns the folder and the manifest [(file number, documents, ids)], of one row a file. Null text: only the end id.
    Null doc_id: first. Repeated doc_id: both kept, ordered by text. Empty table: no files. Other columns are ignored."""
    out = out or new_path(docs.sparkSession, "tokens")

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        if (first := next(batches, None)) is None:
            return
        enc = Encoder(tokenizer)
        kind = _id_type(enc.vocab)
        schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        ids, lengths, total = [], [], 0

        def save(stream):
            nonlocal total
            with pa.ipc.new_file(stream, schema) as writer:
                pending, have, per = [], 0, seq_len * batch_rows

                def flush(last: bool):
                    nonlocal pending, have
                    flat = np.concatenate(pending) if pending else np.empty(0, kind)
                    n = len(flat) // per * per
                    for at in range(0, n, per):
                        emit(flat[at : at + per], per)
                    rest = flat[n:]
                    if last and len(rest):
                        padded = np.zeros(-(-len(rest) // seq_len) * seq_len, kind)
                        padded[: len(rest)] = rest
                        emit(padded, len(rest))
                        rest = rest[:0]
                    pending, have = [rest.copy()], len(rest)

                def emit(values, valid):
                    mask = np.arange(len(values)) < valid
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), seq_len) for x in (values, mask)]
                    writer.write_batch(pa.record_batch(lists, schema=schema))

                for part, texts in encoded(itertools.chain([first], batches), tokenizer, end_id):
                    ids.extend(part.column("doc_id").to_pylist())
                    for x in texts:
                        lengths.append(len(x) // 4)
                        total += len(x) // 4
                        pending.append(np.frombuffer(x, "<u4").astype(kind))
                        have += len(x) // 4
                        if have >= 4 * per:
                            flush(False)
                flush(True)

        put_file(f"{out}/shard-{shard:06d}.tokens.arrow", save)
        index = pa.record_batch([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

        def save_index(stream):
            with pa.ipc.new_file(stream, index.schema) as writer:
                writer.write_batch(index)

        put_file(f"{out}/shard-{shard:06d}.index.arrow", save_index)
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = ordered.mapInArrow(write, "shard long, n_docs long, n_tokens long")
    return out, sorted((r.shard, r.n_docs, r.n_tokens) for r in done.collect())  # a row a file


def read_token_files(spark, out: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32."""
    rows, base = [], 0
    for shard, _, n in manifest:
        rows.append((f"{out}/shard-{shard:06d}", base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for stem, at in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = filesystem(stem + ".index.arrow")
                with fs.open_input_file(path) as f:
                    index = pa.ipc.open_file(f).read_all()
                lengths = index.column("n_tokens").to_numpy()
                ends = np.cumsum(lengths)
                crc, doc = np.zeros(len(lengths), np.int64), 0
                fs, path = filesystem(stem + ".tokens.arrow")
                source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
                with source, pa.ipc.open_file(source) as reader:
                    place, running = 0, 0
                    for i in range(reader.num_record_batches):
                        b = reader.get_batch(i)
                        flat = b.column("tokens").flatten().to_numpy().astype("<u4")
                        flat = flat[: int(np.count_nonzero(b.column("mask").flatten().to_numpy(zero_copy_only=False)))]
                        lo = 0
                        while doc < len(ends) and lo < len(flat):
                            hi = min(len(flat), int(ends[doc]) - place)
                            running = zlib.crc32(flat[lo:hi].tobytes(), running)
                            if place + hi == ends[doc]:
                                crc[doc], running, doc = running, 0, doc + 1
                            lo = hi
                        place += len(flat)
                yield pa.record_batch([index.column("doc_id").combine_chunks(), pa.array(at + ends - lengths), pa.array(lengths), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "stem string, base long").repartition(len(rows))
    return files.mapInArrow(read, schema)


def sequence(out: str, shard: int, row: int, batch_rows: int = 256):
    """(ids, mask) of one sequence of a local file, as views of its memory map."""
    import pyarrow as pa

    _, path = filesystem(f"{out}/shard-{shard:06d}.tokens.arrow")
    b = pa.ipc.open_file(pa.memory_map(path)).get_batch(row // batch_rows)
    return b.column("tokens")[row % batch_rows].values.to_numpy(), b.column("mask")[row % batch_rows].values
