"""Exact top-k search by inner product with MaxScore over shards of posting lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of one shard, and queries that meet a shard at once; terms between two looks at the threshold.
SHARD, BLOCK, STEP = 8192, 4096, 8


class Shard:
    """Posting lists of integer vectors: one for each dimension, with signed impacts and their greatest either way."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.most, self.least = (f(axis=1, initial=0) for f in (self.columns.max, self.columns.min))
        self.met = self.scored = 0

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to smaller ids; own is left out.

        A term is a dimension that the query weighs; its bound is the most that a vector can
        gain from it, and what a vector gains or loses is its signed impact. Terms come from the
        largest bound down. Once k scores are known, the smallest terms whose bounds together
        stay under the k-th are non-essential: a vector that gains from them alone can't get
        in. Essential terms are traversed for all vectors that still compete, and after every
        few of them those that lead so far are scored, so the k-th score rises; non-essential
        terms are then probed for what is left. A vector is given up as soon as what it has
        and all bounds left don't reach the k-th score; only what remains at the end has its
        whole score.
        """
        weights = query.tolist()
        terms = sorted((int(max(w * self.most[d], w * self.least[d])), d, w) for d, w in enumerate(weights) if w)
        bounds = np.cumsum([0, *(t[0] for t in terms)])
        live, need, essential = np.flatnonzero(self.ids != own), None, 0
        total, tried = np.zeros(len(live), np.int64), np.zeros(len(self.ids), bool)
        self.met += len(live)
        best = np.zeros(0, np.int64)
        for at in range(len(terms) - 1, -1, -1):
            _, d, w = terms[at]
            impacts = self.columns[d]
            total += w * (impacts if len(live) == len(impacts) else impacts[live])
            if (len(terms) - at) % STEP and at != essential or len(live) <= k:
                continue
            lead = live[np.argpartition(-total, 2 * k)[: 2 * k]] if len(live) > 2 * k else live
            lead = lead[~tried[lead]]
            tried[lead] = True
            self.scored += len(lead)
            best = np.sort(np.concatenate((best, self.vectors[lead] @ query)))[-k:]
            if len(best) == k:
                need = int(best[0])
                essential = int(np.searchsorted(bounds[1:], need, "left"))
                keep = total + bounds[at] >= need
                live, total = live[keep], total[keep]
        self.scored += int((~tried[live]).sum())
        order = np.lexsort((self.ids[live], -total))[:k]
        return self.ids[live][order], total[order]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component. Rows with a null id or vector, or with a
    null, infinite or NaN component, are left out; of rows with one id the least vector stays.

    Components of which scale times beyond 64 bits keep what fits in them, and scores that leave 64
    bits are not defined. An empty vector stays and scores 0 with any other. An empty table
    gives an empty result.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull()).filter(~odd)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, all if fewer.

    vectors and queries are (id, v) with one row an id; a query's own id is no candidate; ties
    go to the smaller id; shorter vectors count as followed by zeros. Vectors are dealt into
    shards of about SHARD rows and queries into blocks of about BLOCK, by hash; each pair of
    shard and block is one task's work, so a task holds the same at any size of the tables.
    At most k rows a query and shard go on to the merge. Two counts reach the driver.
    """
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(deal(shards).alias("shard"), every(blocks).alias("block"), "id", "v")
    right = queries.select(every(shards).alias("shard"), deal(blocks).alias("block"), "id", "v")

    def search(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(candidates) and len(asked):
            width = max(candidates.v.map(len).max(), asked.v.map(len).max())
            shard = Shard(candidates.id.to_numpy(), _matrix(candidates.v, width))
            for q, v in zip(asked.id.to_numpy(), _matrix(asked.v, width), strict=True):
                ids, scores = shard.search(q, v, k)
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
