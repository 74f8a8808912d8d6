"""Quality: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import sample
from .shared import slices

#: Labelled documents that the model is fitted on at most, of each label.
FIT_EACH = 2500
#: Words in a passage; buckets of word shapes.
PASSAGE, SHAPES = 128, 32
WIDTH = SHAPES + 14


def shape(word: str) -> int:
    """Bits of a word: its shape's bucket, flags and length, of all its characters. The shape has a letter for each kind of
    character, runs once."""
    import zlib

    kinds = ["9" if c.isdigit() else "a" if c.isalpha() and not c.isupper() else "A" if c.isalpha() else c for c in word]
    runs = "".join(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1])
    letters = sum(k in "aA" for k in kinds)
    signs = len(kinds) - letters - kinds.count("9")
    flags = (letters == 0) | (signs > 1) << 1 | (kinds.count("A") > 1) << 2 | ("9" in kinds) << 3 | (runs[-1:] in ".!?") << 4 | (letters > 0 and signs >= letters) << 5
    return zlib.crc32(runs.encode()) % SHAPES | flags << 8 | len(word) << 16


class Passages:
    """Encodes texts passage by passage; shapes of words that were seen are kept, in a table of bounded size."""

    def __init__(self, keep: int = 100_000):
        self.keep, self.known = keep, {}

    def _shape(self, word: str) -> int:
        code = shape(word)
        if len(self.known) >= self.keep:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = code
        return code

    def __call__(self, texts: list[str | None]):
        """(features of all passages, first passage of each text); a text without words has one passage of zeros."""
        import numpy as np

        get, new = self.known.get, self._shape
        codes, hashes, sizes, lines = [], [], [], []
        for text in texts:
            words = (text or "").split()
            codes.append(np.array([new(w) if (v := get(w)) is None else v for w in words], np.int64))
            hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
            sizes.append(len(words))
            lines.append((text or "").count("\n") / max(1, len(words)))
        sizes = np.array(sizes)
        counts = np.maximum(1, -(-sizes // PASSAGE))
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        total = int(counts.sum())
        x = np.zeros((total, WIDTH))
        n = int(sizes.sum())
        if n:
            code, word = np.concatenate(codes), np.concatenate(hashes)
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            passage = np.repeat(first, sizes) + (np.arange(n) - np.repeat(start, sizes)) // PASSAGE
            size = np.maximum(1, np.bincount(passage, minlength=total))
            x[:, :SHAPES] = np.bincount(passage * SHAPES + (code & 255), minlength=total * SHAPES).reshape(total, SHAPES) / size[:, None]
            for k in range(6):
                x[:, SHAPES + k] = np.bincount(passage, (code >> 8 >> k) & 1, total) / size
            length = (code >> 16).astype(float)
            mean = np.bincount(passage, length, total) / size
            x[:, SHAPES + 6] = mean / 10
            x[:, SHAPES + 7] = np.sqrt(np.maximum(0, np.bincount(passage, length**2, total) / size - mean**2)) / 5
            same = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
            x[:, SHAPES + 8] = np.bincount(passage[1:], same, total) / size
            order = np.lexsort((word, passage))
            p, w = passage[order], word[order]
            new_word = np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])]
            x[:, SHAPES + 9] = np.bincount(p, new_word, total) / size
            at = np.flatnonzero(new_word)
            most = np.zeros(total)
            np.maximum.at(most, p[at], np.diff(np.r_[at, n]))
            x[:, SHAPES + 10] = most / size
            x[:, SHAPES + 11] = np.log1p(size * (np.bincount(passage, minlength=total) > 0)) / 5
        x[:, SHAPES + 12] = np.repeat(lines, counts)
        x[:, SHAPES + 13] = np.repeat(np.log1p(sizes), counts) / 10
        return x, first


class Model:
    """h = tanh(Wx + b) for each passage; weights a = softmax(w.(tanh(Vh) * sigmoid(Uh))) within a document; the score is
    sigmoid(c.sum(a h) + d)."""

    def __init__(self, constant: float | None = None, hidden: int = 24, gate: int = 12):
        self.constant, self.hidden, self.gate = constant, hidden, gate
        self.p: dict = {}

    def _forward(self, x, first):
        import numpy as np

        p = self.p
        count = np.diff(np.r_[first, len(x)])
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        a = e / np.repeat(np.add.reduceat(e, first), count)
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return count, h, t, s, a, z, y

    def _gradients(self, x, first, target, weight) -> dict:
        """Of the weighted cross-entropy, by parameter."""
        import numpy as np

        count, h, t, s, a, z, y = self._forward(x, first)
        p, g = self.p, {}
        dy = (y - target) * weight
        g["c"], g["d"] = z.T @ dy, np.array([dy.sum()])
        dz = np.repeat(dy[:, None] * p["c"], count, 0)
        dh = a[:, None] * dz
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), count))
        g["w"] = (t * s).T @ de
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (dh + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, x, first, target, steps: int = 400, rate: float = 0.02, decay: float = 1e-4):
        """Adam on the mean cross-entropy, both labels with equal weight; all passages of a document at once."""
        import numpy as np

        rng = np.random.default_rng(9)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        d, k, g = x.shape[1], self.hidden, self.gate
        self.p = {"W": rng.normal(0, d**-0.5, (d, k)), "b": np.zeros(k), "V": rng.normal(0, k**-0.5, (k, g)), "U": rng.normal(0, k**-0.5, (k, g)), "w": rng.normal(0, g**-0.5, g), "c": rng.normal(0, k**-0.5, k), "d": np.zeros(1)}
        m, v = ({n: np.zeros_like(q) for n, q in self.p.items()} for _ in (0, 1))
        weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
        for step in range(1, steps + 1):
            p, g = self.p, self._gradients(x, first, target, weight)
            for n in p:
                grad = g[n] + decay * p[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad * grad
                p[n] = p[n] - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, texts, passages: Passages):
        import numpy as np

        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x, first = passages(texts)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), first)[-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on at most FIT_EACH of the given label rows of each label, and on at most FIT_CHARS characters of each (sample()):
    so many passages, at most, reach the driver. With labels of one kind only (or none) the model gives a constant."""
    import numpy as np

    rows = sample(docs, labels, label, {1: FIT_EACH, 0: FIT_EACH})

    def encode(batches):
        import pyarrow as pa

        passages = Passages()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, first = passages(part.column("text").to_pylist())
                x = x.astype(np.float32)
                docs_x = [x[a:b].tobytes() for a, b in zip(first, np.r_[first[1:], len(x)], strict=True)]
                yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array(docs_x, pa.binary())], names=["doc_id", "label", "x"])

    got = sorted(rows.df.mapInArrow(encode, "doc_id long, label int, x binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    rows.drop()
    y = np.array([r["label"] for r in got], float)
    if len(set(y)) < 2:
        return Model(constant=float((y.sum() + 0.5) / (len(y) + 1)))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    return Model().fit(np.concatenate(parts).astype(float), first, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text. Null, empty and blank texts are one passage without words. Repeated rows each
    have theirs; other columns are ignored."""

    def rows(batches):
        import pyarrow as pa

        passages = Passages()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.record_batch([part.column("doc_id"), pa.array(model.scores(part.column("text").to_pylist(), passages))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least the threshold; one that scores just that stays. A null
    text scores as an empty one, a null doc_id changes nothing, repeated rows stay or go together."""
    from .toxicity import select_rows

    return select_rows(docs, Passages, model, lambda s: s >= threshold)
