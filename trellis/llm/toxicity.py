"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .shared import slices

#: Labelled documents that the model is fitted on at most: toxic, clean.
FIT_TOXIC, FIT_CLEAN = 2500, 7500
#: Lengths of the word beginnings that the lexicon may hold.
STEMS = (4, 5)
# Second-person words (English, German, French, Spanish) and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine deinen ihr euch tu toi te vous votre vos ton tú ti usted ustedes vos tus".split())
LOOKALIKES = str.maketrans("013457@$!|+€", "oieastasiite")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’…–—¿¡"
FEATURES = ("lexicon", "stem", "obfuscated", "second", "caps", "mixed", "shout", "stretched")


def plain(word: str) -> str:
    return word.lower().strip(_EDGES)


def folded(word: str) -> str:
    """The word behind an obfuscation: lookalikes as letters, other signs dropped, repeats of three or more as one."""
    low = word.lower().strip(".,;:?\"'()[]{}«»“”…").rstrip("!").translate(LOOKALIKES)
    return re.sub(r"(.)\1{2,}", r"\1", "".join(c for c in low if c.isalpha()))


class Features:
    """Dense features of texts. Flags of words that were seen are kept, in a table of bounded size."""

    def __init__(self, lexicon: frozenset[str], keep: int = 100_000):
        self.lexicon, self.keep, self.flags = lexicon, keep, {}

    def _flag(self, word: str) -> int:
        w = plain(word)
        lex = w in self.lexicon
        stem = len(w) >= STEMS[0] and any(f"^{w[:k]}" in self.lexicon for k in STEMS if len(w) >= k)
        core = word.strip(_EDGES)
        mixed = len(core) > 2 and not core.isalpha() and any(c.isalpha() for c in core)
        stretched = re.search(r"(.)\1\1", core) is not None
        hidden = False
        if not lex and (mixed or stretched or core != word):
            f = folded(word)
            hidden = f != w and (f in self.lexicon or (not stem and len(f) >= STEMS[0] and any(f"^{f[:k]}" in self.lexicon for k in STEMS if len(f) >= k)))
        flags = lex | stem << 1 | hidden << 2 | (w in SECOND_PERSON) << 3 | (len(core) > 1 and core.isupper()) << 4 | mixed << 5 | word.endswith(("!", "?")) << 6 | stretched << 7
        if len(self.flags) >= self.keep:
            self.flags.clear()
        if len(word) <= 64:
            self.flags[word] = flags
        return flags

    def __call__(self, texts: list[str | None]):
        import numpy as np

        out = np.zeros((len(texts), 2 * len(FEATURES) + 8))
        get, flag = self.flags.get, self._flag
        for row, text in zip(out, texts, strict=True):
            words = (text or "").split()
            if not words:
                continue
            f = np.array([flag(w) if (v := get(w)) is None else v for w in words], np.uint8)
            n, chars = len(f), len(text)
            bits = np.unpackbits(f[:, None], axis=1, bitorder="little")
            counts = bits.sum(0, dtype=np.int64)
            row[:8], row[8:16] = counts / n, np.log1p(counts)
            hits = np.flatnonzero(f & 7)
            you = np.flatnonzero(f & 8)
            if len(hits) and len(you):
                at = np.searchsorted(you, hits)
                gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
                row[16], row[17] = (gap <= 5).mean(), 1 / (1 + gap.min())
            row[18] = len(hits) / n
            row[19] = np.log1p(len(hits))
            row[20] = text.count("!") / chars
            row[21] = text.count("?") / chars
            row[22] = sum(text.count(c) for c in "*#@$%&") / chars
            row[23] = np.log(n)
        return out


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> frozenset[str]:
    """The words and word beginnings (^...) that mark label 1: in at least 0.4 % (and four) of its documents, twenty times
    as frequent there as in the others. rows: (text, label), a sample of bounded size, which bounds the lexicon."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found: Counter = Counter()
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    words = {plain(w) for w in text.split()} - {""}
                    words |= {f"^{w[:k]}" for w in words for k in STEMS if len(w) >= k}
                    found.update((w, label) for w in words)
                if found:
                    yield pa.record_batch([pa.array([w for w, _ in found]), pa.array([v for _, v in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "label", "n"])

    counted = rows.mapInArrow(count, "word string, label int, n long").groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 1, 0).otherwise(F.col("n"))).alias("clean"))
    least = max(4, n_toxic * 4 // 1000)
    odds = (F.col("toxic") + 0.5) / max(1, n_toxic) >= 20 * (F.col("clean") + 0.5) / max(1, n_clean)
    kept = counted.where((F.col("toxic") >= least) & odds)
    return frozenset(r["word"] for r in kept.collect())


class Model:
    def __init__(self, lexicon, trees=None, curve=None, constant: float | None = None):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def scores(self, texts, features: Features):
        import numpy as np

        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.clip(self.curve(self.trees.raw(features(texts))), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on at most FIT_TOXIC + FIT_CLEAN of the given label rows: four fifths, by a hash of doc_id, give the lexicon and
    the trees, the other fifth, which neither has seen, the curve. With labels of one kind only (or none) the model gives a
    constant; with one kind only on either side, all rows serve both."""
    import numpy as np

    from .trees import Boosted, Isotonic

    rows = sample(docs, labels, label, {1: FIT_TOXIC, 0: FIT_CLEAN})
    grows = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) > 0
    marked = rows.df.withColumn("grows", grows)
    counts = {(r["label"], r["grows"]): r["count"] for r in marked.groupBy("label", "grows").count().collect()}
    n1, n0 = (counts.get((v, True), 0) + counts.get((v, False), 0) for v in (1, 0))
    if not n1 or not n0:
        return Model(frozenset(), constant=(n1 + 0.5) / (n1 + n0 + 1))
    if len(counts) < 4:
        marked, counts = rows.df.withColumn("grows", F.lit(True)), {(1, True): n1, (0, True): n0}
    lexicon = learn_lexicon(marked.where("grows"), counts[1, True], counts[0, True])

    def encode(batches):
        import pyarrow as pa

        features = Features(lexicon)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = features(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), part.column("label"), part.column("grows"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "grows", "x"])

    got = marked.mapInArrow(encode, "doc_id long, label int, grows boolean, x array<double>").toPandas().sort_values(["doc_id", "label"])
    rows.drop()
    x, y = np.stack(got["x"].to_numpy()), got["label"].to_numpy().astype(float)
    turn = got["grows"].to_numpy(dtype=bool)
    trees = Boosted().fit(x[turn], y[turn])
    held = ~turn if not turn.all() else turn
    return Model(lexicon, trees, Isotonic().fit(trees.raw(x[held]), y[held]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text. Null, empty and blank texts have the score of a text without words. Repeated
    rows each have theirs; other columns are ignored."""

    def rows(batches):
        import pyarrow as pa

        features = Features(model.lexicon)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.record_batch([part.column("doc_id"), pa.array(model.scores(part.column("text").to_pylist(), features))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold; one that scores just that goes. A null
    text scores as an empty one, a null doc_id changes nothing, repeated rows stay or go together."""
    return select_rows(docs, lambda: Features(model.lexicon), model, lambda s: s < threshold)


def select_rows(docs: DataFrame, features, model, test) -> DataFrame:
    """The rows whose text's score passes the test, without a join: rows stream through the model."""

    def rows(batches):
        import pyarrow as pa

        encode = features()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                keep = test(model.scores(part.column("text").to_pylist(), encode))
                if keep.any():
                    yield part.filter(pa.array(keep))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(rows, typed.schema)


