"""Filter interaction audit: what each filter takes in every order of all, from counts by mask and a subset-zeta transform."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solarweave.storage import joined_back, stored

#: Fixed values of the query: the filters' letters, words, and the limits of A, B and C.
FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, r"[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails each filter that looks at it alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def _mask(fails: dict[str, Column], filters: str) -> Column:
    """The failed filters as bits, the first letter's is 1."""
    bits = [F.when(F.coalesce(fails[f], F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(filters)]
    return sum(bits[1:], bits[0])


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of every row of docs: the filters that it fails, and its labels as 0 or 1.

    E fails a text (null: empty) that some row of a smaller id has as well, in any part; a null
    id is neither smaller nor larger. Equal texts are told by their sha256. An id with several
    labels is good or toxic if one of them says so. A null part is the empty string.
    """
    alone = failures(F.col(f"`{text}`"))
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("digest"), _mask(alone, "ABCD").alias("alone"))
    own = stored(own, "failures")
    first = own.groupBy("digest").agg(F.min("id").alias("first"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
    marks = stored(marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")), "marks")
    every = joined_back(own, first, "digest").join(marks, "id", "left")
    again = F.coalesce(F.col("first") < F.col("id"), F.lit(False)).cast("int")
    return every.select("part", (F.col("alone") + 16 * again).alias("mask"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def subset_sums(counts: Column, bits: int):
    """Steps of the subset-zeta transform: each gives an array whose entry for a set of bits holds also the one without that bit.

    After all of them, entry T is the sum of the counts of all subsets of T.
    """
    for i in range(bits):
        yield lambda held, bit=1 << i: F.transform(held, lambda x, t: F.when(t.bitwiseAND(F.lit(bit)) != 0, x + F.get(held, t - bit)).otherwise(x))


def survivors(parts: DataFrame, column: str, bits: int) -> DataFrame:
    """parts whose column, counts by mask, becomes for every set T the documents that fail none but filters of T."""
    for step in subset_sums(F.col(column), bits):
        parts = parts.withColumn(column, step(F.col(column)))
    return parts


def interactions(marked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order of the filters, step by step, for each part of marked (part, mask, good, toxic): the columns of the query.

    Documents are counted by part and mask, and labels likewise: at most 2**n rows for a part.
    A subset-zeta transform makes of them, for each set of filters, the documents that survive
    it. What a step takes is the difference between two neighbouring sets, and so are the
    labels that it loses; what a filter takes over all orders weighs each difference by the
    orders that have it. No document is touched after the counts, and no order is replayed.
    """
    n, size = len(filters), 1 << len(filters)
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    kinds = ("docs", "good", "toxic")
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("held"))

    def listed(kind: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at("held", m)[kind], F.lit(0)).cast("long")).alias(kind)

    parts = by_mask.select("part", *map(listed, kinds))
    for k in kinds:
        parts = survivors(parts, k, n)

    left = lambda k, applied: F.get(F.col(k), F.lit(size - 1) - applied)  # noqa: E731  (survivors of a set of applied filters)
    orders = ["".join(p) for p in permutations(filters)]
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = {f: F.instr("filter_order", f) for f in filters}
    weigh = lambda test: sum((F.when(test(place[f]), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumns({"before": weigh(lambda p: p < F.col("step")), "bit": weigh(lambda p: p == F.col("step"))})
    after, others = F.col("before") + F.col("bit"), F.lit(size - 1) - F.col("bit")
    removed = left("docs", F.col("before")) - left("docs", after)
    orders_of = F.array(*(F.lit(factorial(i) * factorial(n - 1 - i)) for i in range(n)))
    share = lambda s: F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(orders_of, F.bit_count(s)) * (left("docs", s) - left("docs", s + F.col("bit")))).otherwise(0)
    return rows.select(
        "part", "filter_order", "step", left("docs", after).alias("kept"), removed.alias("removed"),
        (left("docs", F.lit(0)) - left("docs", F.col("bit")) - removed).alias("redundant"), (left("docs", others) - left("docs", F.lit(size - 1))).alias("unique_fails"),
        (left("good", F.col("before")) - left("good", after)).alias("good_lost"), (left("toxic", F.col("before")) - left("toxic", after)).alias("toxic_lost"),
        F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), lambda total, s: total + share(s).cast("long")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions of the five filters over docs, by source.

    Null and empty texts have no words, so they fail A, and E beside any smaller id without
    text. Repeated rows count each. An empty table gives no row. A text is looked at in its own
    task; what meets others is its digest, its id, and its mask.
    """
    return interactions(masks(docs, labels))
