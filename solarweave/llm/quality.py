"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, octets
from solarweave.llm.labels import held_out, sample

#: Buckets of hashed words, rank of the interactions, labelled documents that training takes at most.
BUCKETS, RANK, MOST_LABELLED = 1 << 14, 4, 6000
STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digit", "mark", "pipe", "bang", "other_mark",
    "space", "repeated_words", "top_word", "repeated_lines", "line_length", "open_lines", "log_chars",
)
_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((range(65, 91), range(48, 58), b".,;:'\"()-?", b"|", b"!", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\n\r\x0b\x0c"), 1):
    _KIND[list(_bytes)] = _kind


def statistics(text: bytes, words: list[bytes], n_chars: float | None) -> list[float]:
    """STATISTICS of one whole text; of an empty one all but the metadata are 0."""
    size = len(text)
    if not size:
        return [0.0] * (len(STATISTICS) - 1) + [np.log1p(n_chars or 0)]
    share = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 8)[1:] / size
    n, lines = max(1, len(words)), [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    most = max(counts.values(), default=0)
    closed = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    return [
        np.log1p(size), np.log1p(len(words)), lengths.mean(), lengths.std(), share[0], share[1], share[2], share[3], share[4], share[5], share[6],
        1 - len(counts) / n, most / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(size / max(1, len(lines))), 1 - closed / max(1, len(lines)), np.log1p(n_chars or 0),
    ]


def features(text: bytes, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the distinct words, their weights (of length 1 together), and the statistics."""
    words = text.split()
    counts = np.bincount(np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in set(map(bytes.lower, words))), np.int64), minlength=1) if words else np.zeros(0)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at] / max(1, counts.sum()))
    return at.astype(np.int32), value.astype(np.float32), statistics(text, words, n_chars)


@dataclass
class Machine:
    """bias + <w, x> + the sum over pairs of <v_i, v_j> x_i x_j, in time linear in the inputs."""

    mean: np.ndarray
    scale: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, at: np.ndarray, value: np.ndarray, stats) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((np.asarray(stats) - self.mean) / self.scale, -4, 4)
        return np.concatenate((at, np.arange(BUCKETS, BUCKETS + len(z)))), np.concatenate((value, z))

    def score(self, at: np.ndarray, value: np.ndarray, stats) -> float:
        """0 to 1; pairs by half the square of the sum less the sum of squares."""
        i, x = self.inputs(at, value, stats)
        v = self.v[i] * x[:, None]
        z = self.bias + self.w[i] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], y: np.ndarray, epochs: int = 12, rate: float = 0.1, ridge: float = 2e-4, seed: int = 3) -> Machine:
    """A machine by Adagrad on the logistic loss. With no rows the score is 0.5 everywhere."""
    rng, width = np.random.default_rng(seed), BUCKETS + len(STATISTICS)
    stats = np.array([r[2] for r in rows]).reshape(-1, len(STATISTICS))
    mean, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if len(rows) else (np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    m = Machine(mean, scale, 0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK)))
    if not len(rows):
        return m
    inputs = [m.inputs(*r) for r in rows]
    sum_w, sum_v, sum_b = np.full(width, 1e-6), np.full((width, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            i, x = (np.concatenate([inputs[k][j] for k in some]) for j in (0, 1))
            n = np.array([len(inputs[k][0]) for k in some])
            row, first = np.repeat(np.arange(len(some)), n), np.concatenate(([0], np.cumsum(n)[:-1]))
            v = m.v[i] * x[:, None]
            total = np.add.reduceat(v, first)
            z = m.bias + np.bincount(row, m.w[i] * x, len(some)) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), first))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            gx = g[row] * x
            gw = np.bincount(i, gx, width) + ridge * m.w
            by = gx[:, None] * (total[row] - v)
            gv = np.stack([np.bincount(i, by[:, k], width) for k in range(RANK)], axis=1) + ridge * m.v
            sum_w += gw**2
            sum_v += gv**2
            sum_b += g.sum() ** 2
            m.w -= rate * gw / np.sqrt(sum_w)
            m.v -= 0.5 * rate * gv / np.sqrt(sum_v)
            m.bias -= rate * g.sum() / np.sqrt(sum_b)
    return m



def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> Machine:
    """A machine from at most MOST_LABELLED labelled documents that aren't held out."""
    packed = docs.select(F.col(key), F.struct(F.col(text).alias("text"), F.col(chars).cast("double").alias("chars")).alias(text)) if chars in docs.columns else docs.select(F.col(key), F.struct(F.col(text).alias("text"), F.lit(None).cast("double").alias("chars")).alias(text))
    rows = sample(packed, labels, label, MOST_LABELLED, None, key, text).select("y", "t.text", "t.chars")

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            got = [features(t, c) for t, c in zip(octets(batch.column("text")), batch.column("chars").to_pylist(), strict=True)]
            return {"y": batch.column("y"), "at": [g[0] for g in got], "value": [g[1] for g in got], "stats": [list(map(float, g[2])) for g in got]}

        return each

    got = by_batch(rows, "y int, at array<int>, value array<float>, stats array<double>", start).toPandas()
    return train(list(zip(got["at"], got["value"], got["stats"], strict=True)), got.y.to_numpy(np.float64))


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", chars: str = "n_chars", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text, higher for better.

    Null texts count as empty; a missing count of characters as 0; a null id is not held out. No shuffle.
    """

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            rows = zip(octets(batch.column("t")), batch.column("c").to_pylist(), strict=True)
            return {"k": batch.column("k"), "score": [machine.score(*features(t, c)) for t, c in rows]}

        return each

    n = F.col(f"`{chars}`").cast("double") if chars in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), n.alias("c"))
    out = by_batch(rows, f"k {rows.schema['k'].dataType.simpleString()}, score double", start)
    return out.select(F.col("k").alias(key), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
