"""Labelled rows for training: a bounded sample by hash, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of five folds by crc32 of the id, this one is never trained on.
FOLDS, HELD_OUT = 5, 0


def held_out(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, only: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, t) of at most most labelled documents outside the held-out fold, least hashes first.

    only keeps one label. Null ids and labels are left out; an id labelled twice has its
    highest label; of rows with one id, those least by hash of the text are taken within most.
    The sample's size is bounded by most, so it may be broadcast and gathered.
    """
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).cast("long").alias("__id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("y") == only) if only is not None else own
    own = own.orderBy(F.xxhash64("__id"), "__id", F.desc("y")).limit(most).groupBy("__id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("t")).join(F.broadcast(own), "__id")
    return rows.orderBy(F.xxhash64("__id"), F.xxhash64("t")).limit(most).select("y", "t")
