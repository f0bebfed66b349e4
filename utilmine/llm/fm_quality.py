"""Quality classifier: a second-order factorisation machine over sparse features.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in linear
time as half of (sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2, summed over the factors.

Features of a whole text: hashed words (log counts scaled to unit length), structure statistics
(bucketed into indicator features, so that pairs of buckets interact) and the length in characters as metadata.
Language, source and ids are never features.

Training takes at most ``max_train`` labelled rows, half of each class where there are enough, chosen
by the hash of the id; only their sparse features come to the driver. The model has a fixed size and is broadcast.

Edge cases: null text is the empty text, which gets a score from its structure features; rows without
a label are scored only; null or repeated label rows count once per id (the smallest label), and of documents that share an id
one is learned from (the smallest text); with no usable labels of one class every score is 0.5 plus the prior of the other; rows with null or
repeated ids are each scored; an empty table gives no rows; columns of the input pass through, but for one named as the score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import as_text, spread, trimmed

WORD_BITS = 15
WORDS = 1 << WORD_BITS
#: Upper borders of the buckets of a share between 0 and 1.
SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
#: Upper borders of the buckets of a count or length.
COUNTS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 30, 50, 80, 130, 200, 400, 800, 1600, 3200, 10_000, 100_000], dtype=float)
SHARE_NAMES = ("upper", "digit", "space", "symbol", "stop", "comma", "other", "same_neighbour", "distinct", "symbol_word", "upper_word", "bar_word", "short_word", "long_word", "repeated_line", "top_word")
COUNT_NAMES = ("words", "chars", "lines", "word_length", "line_words", "longest_run", "longest_line")
BUCKETS = max(len(SHARES), len(COUNTS)) + 1
FEATURES = WORDS + BUCKETS * (len(SHARE_NAMES) + len(COUNT_NAMES))

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _SPACE, _STOP, _COMMA = b"0123456789", b" \t\n\r", b".", b",;:"
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP + _COMMA)
_WORD_SYMBOLS = frozenset("#$%&*!|<>{}[]^~=+_@\\/")


def statistics(text: str, words: list[str], counts: Counter) -> tuple[list[float], list[float]]:
    """Shares and counts that describe the structure of a text."""
    data = text.encode("utf-8", "surrogatepass")
    size, n = max(1, len(data)), max(1, len(words))

    def share(these: bytes) -> float:
        return (len(data) - len(data.translate(None, these))) / size

    lines = text.split("\n")
    run = longest = 0
    neighbours = 0
    for same in map(eq, words, words[1:]):
        if same:
            neighbours += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run = 0
    symbol = upper = bar = short = long = 0
    for w, c in counts.items():
        if w[-1] in _WORD_SYMBOLS:
            symbol += c
        if len(w) <= 2:
            short += c
            bar += c * (w == "|")
        elif w.isupper():
            upper += c
        if len(w) > 15:
            long += c
    known = [share(x) for x in (_UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP, _COMMA)]
    other = (len(data) - len(text)) / size
    repeated = 1 - len(set(lines)) / len(lines)
    top = max(counts.values(), default=0) / n
    shares = [*known, other, neighbours / n, len(counts) / n, symbol / n, upper / n, bar / n, short / n, long / n, repeated, top]
    numbers = [len(words), len(text), len(lines), sum(map(len, counts)) / max(1, len(counts)), len(words) / len(lines), longest, max(map(len, lines))]
    return shares, numbers


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text; indices are distinct and ascending within words and statistics."""
    words = text.split()
    counts = Counter(words)
    shares, numbers = statistics(text, words, counts)
    index = [WORDS + i * BUCKETS + b for i, b in enumerate(np.searchsorted(SHARES, shares).tolist())]
    index += [WORDS + (len(SHARE_NAMES) + i) * BUCKETS + b for i, b in enumerate(np.searchsorted(COUNTS, numbers).tolist())]
    fixed = np.array(index, dtype=np.int64)
    if not counts:
        return fixed, np.ones(len(fixed))
    crc, mask = zlib.crc32, WORDS - 1
    hashed = np.fromiter((crc(w.lower().encode("utf-8", "surrogatepass")) & mask for w in counts), dtype=np.int64, count=len(counts))
    weight = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    at, where = np.unique(hashed, return_inverse=True)
    value = np.bincount(where, weights=weight)
    value /= np.sqrt((value * value).sum())
    return np.concatenate((at, fixed)), np.concatenate((value, np.ones(len(fixed))))


class FactorisationMachine:
    """w0, w and the factors V of a trained model."""

    def __init__(self, rank: int = 4, seed: int = 7):
        random = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(FEATURES)
        self.v = random.normal(0, 0.02, (FEATURES, rank))

    def margins(self, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each row of a sparse block (row k has entries start[k] up to start[k+1]), and its factor sums."""
        xv = self.v[index] * value[:, None]
        sums = np.add.reduceat(xv, start, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), start)
        linear = np.add.reduceat(self.w[index] * value, start)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, text: str) -> float:
        index, value = features(text)
        margin, _ = self.margins(index, value, np.zeros(1, dtype=np.int64))
        return float(sigmoid(margin)[0])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> "FactorisationMachine":
        """AdaGrad on the logistic loss; the two classes weigh the same."""
        positive = labels.mean() if len(labels) else 0.5
        if not 0 < positive < 1:
            self.w0 = float(np.log((positive * len(labels) + 1) / ((1 - positive) * len(labels) + 1)))
            return self
        weight = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
        random = np.random.default_rng(seed)
        seen_w, seen_v, seen_0 = np.full(FEATURES, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                size = np.array([len(rows[k][0]) for k in chosen])
                start = np.concatenate(([0], np.cumsum(size)[:-1]))
                index = np.concatenate([rows[k][0] for k in chosen])
                value = np.concatenate([rows[k][1] for k in chosen])
                margin, sums = self.margins(index, value, start)
                slope = (sigmoid(margin) - labels[chosen]) * weight[chosen] / len(chosen)
                each = np.repeat(slope, size) * value
                touched, where = np.unique(index, return_inverse=True)
                grad_w = np.bincount(where, weights=each, minlength=len(touched)) + l2 * self.w[touched]
                inner = each[:, None] * (np.repeat(sums, size, axis=0) - self.v[index] * value[:, None])
                grad_v = np.stack([np.bincount(where, weights=inner[:, f], minlength=len(touched)) for f in range(self.v.shape[1])], axis=1) + l2 * self.v[touched]
                seen_w[touched] += grad_w**2
                seen_v[touched] += grad_v**2
                seen_0 += slope.sum() ** 2
                self.w[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
                self.v[touched] -= 0.3 * rate * grad_v / np.sqrt(seen_v[touched])
                self.w0 -= rate * slope.sum() / np.sqrt(seen_0)
        return self


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def held_out(id_col: str = "doc_id") -> "F.Column":
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 6_000, **options) -> FactorisationMachine:
    """Fit on at most ``max_train`` labelled rows that are not held out."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    single = usable.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label"))
    mixed = F.xxhash64("label_id", F.lit(11))
    parts = [single.where(F.col("label") == k).orderBy(mixed, "label_id").limit(max_train // 2) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1])  # at most max_train rows of two numbers: safe to broadcast
    rows = docs.select(F.col(id_col).alias("label_id"), as_text(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    rows = rows.groupBy("label_id", "label").agg(F.min("text").alias("text"))  # one text per id, so the bound holds for repeated ids too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [features(t.as_py()) for t in b.column(1)]
            columns = [b.column(0), b.column(2), pa.array([p[0].astype("<i4").tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype("<f4").tobytes() for p in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "at", "value"])

    got = rows.select(F.col("label_id").cast("long"), "text", "label").mapInArrow(trimmed(run), "id long, label int, at binary, value binary").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    at, value = got.column("at").to_pylist(), got.column("value").to_pylist()
    sparse = [(np.frombuffer(at[k], "<i4").astype(np.int64), np.frombuffer(value[k], "<f4").astype(np.float64)) for k in order]
    return FactorisationMachine().fit(sparse, got.column("label").to_numpy()[order].astype(float), **options)


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the score of each whole text; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))
    source = spread(docs.drop(out_col))
    schema = source.withColumn(out_col, F.lit(0.0)).schema
    at = source.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorisationMachine.__new__(FactorisationMachine)
        machine.w0, machine.w, machine.v = shared.value
        for b in batches:
            scores = [machine.score(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out_col])

    return source.mapInArrow(trimmed(run), schema)
