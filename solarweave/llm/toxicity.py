"""Toxicity by non-negative positive-unlabelled learning of a linear model in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, give_back, in_batches, pieces
from solarweave.llm.labels import held_out, sample
from solarweave.storage import stored

#: Hashed features; confirmed and unlabelled documents that training takes at most.
BUCKETS, MOST_CONFIRMED, MOST_UNLABELLED = 1 << 20, 3000, 8000
#: Tasks that make the features of a sample.
SAMPLE_PARTS = 16
MARKS = ".,;:!?*$%&#|\"'()<>"
MOST_WORDS = 200_000
#: A feature is learnt if so many confirmed texts hold it, and they are so many standard deviations more than usual.
LEAST, SURE = 3, 2.5
#: Steps of a score that the cut tells apart, in one unit; and the score beyond which they are one.
GRID, FAR = 64, 64


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself without marks, and its beginnings of 5 and 7 letters."""
    word = word.strip(MARKS)
    if not word:
        return ()
    names = [f"w{word}"] + [f"{n}{word[:n]}" for n in (5, 7) if len(word) >= n]
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


class Features:
    """Distinct features of whole texts; keeps those of words already seen, up to MOST_WORDS."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.chosen = None if chosen is None else dict(zip(chosen.tolist(), range(len(chosen)), strict=True))
        self.words: dict[str, tuple[int, ...]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        found = word_features(word)
        return found if self.chosen is None else tuple(self.chosen[f] for f in found if f in self.chosen)

    def of(self, text: str | None) -> np.ndarray:
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        out: set[int] = set()
        for w in set((text or "").lower().split()):
            found = self.words.get(w)
            if found is None:
                found = self.words[w] = self._word(w)
            if found:
                out.update(found)
        return np.fromiter(out, np.int32, len(out))


def gathered(rows: DataFrame) -> list[np.ndarray]:
    """Features of a bounded sample of texts t, made on the executors."""

    def start():
        features = Features()
        return lambda batch: {"f": [features.of(t) for t in batch.column("t").to_pylist()]}

    return [np.asarray(f, np.int32) for f in by_batch(rows.select("t").repartition(SAMPLE_PARTS), "f array<int>", start).toPandas().f]


@dataclass
class Model:
    chosen: np.ndarray
    weights: np.ndarray
    bias: float
    confirmed: np.ndarray | None = None

    def bin(self, features: np.ndarray) -> int:
        """Step of one text's score above that of no feature, which is in 0."""
        return int(np.floor(np.clip(self.weights[features].sum(), -FAR, FAR) * GRID))

    def score(self, features: np.ndarray) -> float:
        """0 to 1 of one text's chosen features."""
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum() + self.bias, -30, 30))))


def _rows(of: list[np.ndarray], which) -> tuple[np.ndarray, np.ndarray]:
    own = [of[i] for i in which]
    return (np.concatenate(own) if own else np.zeros(0, np.int32)), np.repeat(np.arange(len(own)), [len(x) for x in own])


def cut(confirmed: np.ndarray, bins: np.ndarray, counts: np.ndarray, prior: float) -> float:
    """The score, in units of 1 / GRID above that of no feature, from which on a text is toxic.

    confirmed has the bins of the confirmed texts, bins and counts those of all unlabelled ones.
    Of the confirmed, a share t is at or above a cut, of the unlabelled a share u. Then u - p t
    of all texts are taken wrongly, and p t, but no more than u, rightly: training may have
    learnt the confirmed by heart. The cut is in the middle of those around the least risk that
    cost at most a tenth of the prior p more. No share is flagged by force.
    """
    places = np.arange(1, max(int(bins.max(initial=0)), int(confirmed.max(initial=0)), 0) + 2)
    order = np.argsort(bins)
    below = np.concatenate(([0], np.cumsum(counts[order])))[np.searchsorted(bins[order], places)]
    share = 1 - below / max(1, counts.sum())
    right = prior * (1 - np.searchsorted(np.sort(confirmed), places) / max(1, len(confirmed)))
    risk = prior - np.minimum(right, share) + np.maximum(0, share - right)
    best = int(np.argmin(risk))
    over = np.flatnonzero(risk > risk[best] + 0.1 * prior)
    low, high = over[over < best].max(initial=-1) + 1, over[over > best].min(initial=len(places)) - 1
    return float(places[low] + places[high]) / 2 / GRID


def usual_among(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Which features are more usual among n_p confirmed texts than among n_u of any, at every size by one test.

    The signed root of the likelihood ratio of a count and its expectation holds for small counts
    as well as large ones, and has no least ratio, which a high prior could not reach.
    """
    expected = (in_u + 1) / n_u * n_p
    gain = in_p * np.log(np.maximum(in_p, 1) / expected) - (in_p - expected)
    return (in_p >= LEAST) & (in_p > expected) & (2 * gain > SURE**2)


def train(confirmed: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seen: tuple[np.ndarray, int] | None = None, epochs: int = 60, rate: float = 0.15, ridge: float = 1e-3, seed: int = 5) -> Model:
    """Minimise the class-prior-corrected logistic risk without letting its negative part fall below zero.

    With prior p, P the confirmed and U the unlabelled: p E_P[l(z)] + max(0, E_U[l(-z)] - p
    E_P[l(-z)]); where the part in the bracket is negative in a batch, its gradient is
    followed upwards instead. Only features more usual among the confirmed are inputs, by the
    document frequencies and number of documents in seen, or else those of U. The bias is then moved to the cut of these unlabelled scores, so a text without any input is
    always on the clean side. Without confirmed examples or inputs every score is 0.
    """
    if not confirmed or not unlabelled:
        return Model(np.zeros(0, np.int32), np.zeros(0), -30.0)
    in_p = np.bincount(np.concatenate(confirmed), minlength=BUCKETS)
    in_u, n_u = seen or (np.bincount(np.concatenate(unlabelled), minlength=BUCKETS), len(unlabelled))
    chosen = np.flatnonzero(usual_among(in_p, len(confirmed), in_u, n_u))
    if not len(chosen):
        return Model(np.zeros(0, np.int32), np.zeros(0), -30.0)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    p, u = ([x[x >= 0] for x in (place[f] for f in side)] for side in (confirmed, unlabelled))
    rng, n = np.random.default_rng(seed), len(chosen)
    w, b, sum_w, sum_b = np.zeros(n), float(np.clip(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), -20, 20)), np.full(n, 1e-8), 1e-8
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    batches = max(1, min(len(u) // 500, len(p)))
    for _ in range(epochs):
        for some_p, some_u in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches), strict=True):
            (ip, rp), (iu, ru) = _rows(p, some_p), _rows(u, some_u)
            zp, zu = np.bincount(rp, w[ip], len(some_p)) + b, np.bincount(ru, w[iu], len(some_u)) + b
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior * sigmoid(zp) / len(some_p), sigmoid(zu) / len(some_u)
            gp, gu = (gp - prior * (1 - sigmoid(zp)) / len(some_p), gu) if negative >= 0 else (-gp, -gu)
            g, gb = np.bincount(ip, gp[rp], n) + np.bincount(iu, gu[ru], n) + ridge * w, gp.sum() + gu.sum()
            sum_w += g * g
            sum_b += gb * gb
            w -= rate * g / np.sqrt(sum_w)
            b -= rate * gb / np.sqrt(sum_b)
    model = Model(chosen.astype(np.int32), w, 0.0)
    model.confirmed, counts = np.array([model.bin(x) for x in p]), np.unique([model.bin(x) for x in u], return_counts=True)
    model.bias = -cut(model.confirmed, *counts, prior)
    return model


def frequencies(docs: DataFrame, wanted: np.ndarray, key: str, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents that aren't held out each wanted feature is, and the number of these documents.

    A task returns a row for each wanted feature it saw; these are bounded by the confirmed sample.
    """

    def run(batches):
        features, counts, n = Features(wanted), np.zeros(len(wanted), np.int64), 0
        for batch in (p for b in batches for p in pieces(b)):
            for t in batch.column("t").to_pylist():
                counts[features.of(t)] += 1
            n += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"f": pa.array([-1, *wanted[some].tolist()], pa.int32()), "n": pa.array([n, *counts[some].tolist()], pa.int64())})
        give_back()

    own = docs.filter(~F.coalesce(held_out(key), F.lit(False))).select(F.col(f"`{text}`").alias("t"))
    got = in_batches(own, run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    f, n, out = got.f.to_numpy(np.int64), got.n.to_numpy(np.int64), np.zeros(BUCKETS, np.int64)
    out[f[f >= 0]] = n[f >= 0]
    return out, int(n[f < 0].sum())


def tallied(docs: DataFrame, model: Model, key: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the scores of all documents that aren't held out, and how many each has.

    A task returns a row for each bin it saw, so what is shuffled and gathered is bounded by bins.
    """

    def run(batches):
        features, seen = Features(model.chosen), {}
        for batch in (p for b in batches for p in pieces(b)):
            for t in batch.column("t").to_pylist():
                k = model.bin(features.of(t))
                seen[k] = seen.get(k, 0) + 1
        yield pa.RecordBatch.from_pydict({"bin": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})
        give_back()

    own = docs.filter(~F.coalesce(held_out(key), F.lit(False))).select(F.col(f"`{text}`").alias("t"))
    got = in_batches(own, run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    return got.bin.to_numpy(np.int64), got.n.to_numpy(np.int64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> tuple[Model, float]:
    """A model from at most MOST_CONFIRMED documents labelled 1 and MOST_UNLABELLED of any, none held out, and the prior.

    The prior is the share of 1 among all labels that aren't held out; features are chosen by
    their frequencies in all documents that aren't. The cut is still that of the sample.
    """
    row = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).agg(F.avg(F.col(label).cast("double"))).first()
    prior = float(row[0] or 0)
    any_of = docs.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).select(key, F.lit(1).alias(label))
    confirmed = gathered(sample(docs, labels, label, MOST_CONFIRMED, 1, key, text))
    unlabelled = gathered(sample(docs, any_of, label, MOST_UNLABELLED, None, key, text))
    wanted = np.flatnonzero(np.bincount(np.concatenate(confirmed), minlength=BUCKETS) >= LEAST) if confirmed else np.zeros(0, np.int64)
    out = train(confirmed, unlabelled, prior, frequencies(docs, wanted, key, text) if len(wanted) else None), prior
    confirmed = unlabelled = None
    give_back()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """The model of learn with its cut set over the scores of all documents that aren't held out."""
    model, prior = learn(docs, labels, label, key, text)
    if len(model.chosen):
        model.bias = -cut(model.confirmed, *tallied(docs, model, key, text), prior)
    return model


def _scores(docs: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(k, z): each row's key and the weight of its text's features."""

    def start():
        features = Features(model.chosen)
        return lambda batch: {"k": batch.column("k"), "z": [float(model.weights[features.of(t)].sum()) for t in batch.column("t").to_pylist()]}

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return by_batch(rows, f"k {rows.schema['k'].dataType.simpleString()}, z double", start)


def _judged(scores: DataFrame, bias: float, key: str, threshold: float) -> DataFrame:
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z") + bias))))
    return scores.select(F.col("k").alias(key), F.coalesce(held_out("k"), F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text; null texts count as empty.

    Empty texts have the score of no feature. A null id is not held out. No shuffle.
    """
    return _judged(_scores(docs, model, key, text), model.bias, key, threshold)


def fitted_and_scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """scored by the model of fit, with every text scored once: the cut is set over the scores as they are written."""
    model, prior = learn(docs, labels, label, key, text)
    scores = stored(_scores(docs, model, key, text), "scores")
    if len(model.chosen):
        step = F.floor(F.greatest(F.lit(float(-FAR)), F.least(F.lit(float(FAR)), F.col("z"))) * GRID).cast("long")
        bins = scores.filter(~F.coalesce(held_out("k"), F.lit(False))).groupBy(step.alias("bin")).agg(F.count("*").alias("n")).toPandas()
        model.bias = -cut(model.confirmed, bins.bin.to_numpy(np.int64), bins.n.to_numpy(np.int64), prior)
    return _judged(scores, model.bias, key, threshold)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores under threshold, with all their columns, repeated rows each by itself.

    Null and empty texts have the score of no feature and stay. An empty table stays empty.
    """

    def run(batches):
        features = Features(model.chosen)
        for batch in (p for b in batches for p in pieces(b)):
            keep = [model.score(features.of(t)) < threshold for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return in_batches(docs, run, docs.schema)
