"""Mixing sources to target weights by repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solarweave.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the query: weights by rank of source, repeating, and the most repeats of a source.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Draws of a document: eight hex digits of its digest each.
DRAWS = 16


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, h): the words of each text, and the digest that seeds its draws."""
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), seed_of(key, source, text).alias("h"))


def draw(h, k: int):
    """The k-th number in [0, 1) of a digest."""
    return F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank (from 0) in code point order, null last, without one task over all.

    Ranges of sources are ordered each in its own task; only the counts of the ranges meet.
    """
    ranges = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    counts = ranges.groupBy("part").count()
    before = counts.alias("x").join(F.broadcast(counts.select(F.col("part").alias("p"), F.col("count").alias("n"))), F.col("p") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    return ranges.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with weight and target.

    A target is the smaller of most times the source's size and level times its weight; the
    level rises while sources at their limit give up their excess, until none is above.
    Each round is one aggregate of the table of sources, and one row reaches the driver.
    """
    table = stored(ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")), "sources")
    limit = F.lit(most) * F.col("source_size")
    level, held = 0.0, -1
    while True:
        over = limit <= F.lit(level) * F.col("weight") if held >= 0 else F.lit(False)
        free = F.when(~over, F.col("weight")).otherwise(0)
        total, capped, weight, n = table.agg(F.sum("source_size"), F.sum(F.when(over, limit).otherwise(0)), F.sum(free), F.sum(F.when(over, 1).otherwise(0))).first()
        if not total or n == held:
            break
        held = n
        if not weight:
            break
        level = (total - capped) / weight
    return table.withColumn("target", F.least(limit.cast("double"), F.lit(float(level)) * F.col("weight")))


def seed_of(key: str = "doc_id", source: str = "source", text: str = "text"):
    """128 hex digits from a document's id, source and text, whose parts are its draws: rows without id draw by their texts."""
    first = F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, source, text))), 256)
    return F.concat(first, F.sha2(first, 256))


def goals(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source: s, source_size, target, base and rest of its rate, seed.

    A source has one seed out of DRAWS: that whose extra copies bring its words nearest to its
    target (ties: the first), which one map-side combined aggregate over all documents finds.
    """
    goal = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = stored(goal.select(F.col("source").alias("s"), "source_size", "target", F.floor(rate).cast("long").alias("base"), (rate - F.floor(rate)).alias("rest")), "rates")
    each = sizes.join(goal, F.col("source").eqNullSafe(F.col("s")))
    words = [F.sum(F.when(draw(F.col("h"), k) < F.col("rest"), F.col("size")).otherwise(0)).alias(f"w{k}") for k in range(DRAWS)]
    sums = each.groupBy("s", "source_size", "target", "base", "rest").agg(*words)
    off = [F.struct(F.abs(F.col("base") * F.col("source_size") + F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)]
    return stored(sums.withColumn("seed", F.array_min(F.array(*off))["k"]).drop(*(f"w{k}" for k in range(DRAWS))), "goals")


def copies(h):
    """floor(rate), and one more with the probability of the rest, by the source's seed."""
    extra = F.coalesce(*(F.when(F.col("seed") == k, draw(h, k) < F.col("rest")) for k in range(DRAWS)))
    return F.col("base") + extra.cast("long")


def rates(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document's (doc_id, source, size, source_size, target, copies).

    Null sources are one source, the last in order; null and empty texts have size 0 and are
    copied likewise; repeated rows get the same copies; an empty table gives an empty result.
    The small table of sources is broadcast only if Spark finds at run time that it is small.
    """
    sizes = stored(sized(docs), "sizes")
    goal = goals(sizes, weights, most)
    out = sizes.join(goal, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies(F.col("h")).alias("copies"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as its copies say; all columns stay as they are.

    Columns of docs may be named like those used here: they are packed away meanwhile.
    """
    goal = goals(stored(sized(docs), "sizes"), weights, most)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("source").alias("__source"), seed_of().alias("__h"))
    out = packed.join(goal, F.col("__source").eqNullSafe(F.col("s"))).withColumn("__n", copies(F.col("__h")))
    return out.filter("__n > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select("__row.*")
