"""Training sets: splits by hash, exact duplicates, exclusion near held-out areas, label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.operators.spatial import BOX, far_from, overlap_join
from solarweave.storage import joined_back

#: The seed and shares of the split, and the map of 11 label classes to 8.
SEED, TRAIN_BELOW, VALIDATION_BELOW = "42", 70, 85
CLASS_MAP = {0: 0, 1: 4, 2: 2, 3: 1, 4: 2, 5: 7, 6: 7, 7: 3, 8: 7, 9: 7, 10: 7}
CLASSES = ("pv_installation", "dormer", "skylight", "ladder", "chimney", "shadow", "tree", "unknown_obstacle")
#: Metres between a training chip and a held-out one.
REACH = 100.0


def split_of(key: Column) -> Column:
    """train, val or test in shares of 70, 15 and 15, by the sha256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < TRAIN_BELOW, "train").when(h < VALIDATION_BELOW, "val").otherwise("test")


def first_of_each(df: DataFrame, content: Column, order: str) -> DataFrame:
    """df with digest, duplicate_of (order of the first row of equal content, null for that row) and keep.

    The first is a map-side combined minimum, written and joined back (storage.joined_back), so
    content that very many rows share gathers nowhere; null content counts as empty.
    """
    digest = df.withColumn("digest", F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256))
    first = digest.groupBy("digest").agg(F.min(order).alias("first"))
    out = joined_back(digest, first, "digest")
    return out.withColumn("duplicate_of", F.when(F.col(order) != F.col("first"), F.col("first"))).withColumn("keep", F.col(order) == F.col("first")).drop("first")


def excluded_near(chips: DataFrame, reach: float = REACH) -> DataFrame:
    """Chips (x, y, split) without training ones within reach of a validation or test chip."""
    held = chips.filter("split <> 'train'")
    return far_from(chips.filter("split = 'train'"), held, reach).unionByName(held)


def excluded_in_turn(chips: DataFrame, reach: float = REACH) -> DataFrame:
    """First validation chips near test ones go, then training chips near what is left of both."""
    test = chips.filter("split = 'test'")
    val = far_from(chips.filter("split = 'val'"), test, reach)
    held = test.unionByName(val)
    return held.unionByName(far_from(chips.filter("split = 'train'"), held, reach))


def excluded_overlaps(footprints: DataFrame, margin: float = 2.0, size: float = 64.0) -> DataFrame:
    """Footprints (id, split, box) without those that a kept one of a higher split meets when widened by margin: test, then val, then train."""
    wide = footprints.select("id", *((F.col(c) - margin).alias(c) if c[1] == "1" else (F.col(c) + margin).alias(c) for c in BOX))
    kept = footprints.filter("split = 'test'")
    for split in ("val", "train"):
        own = footprints.filter(F.col("split") == split)
        near = overlap_join(wide.join(own.select("id"), "id", "left_semi"), kept.select("id", *BOX), size).select(F.col("a_id").alias("id")).distinct()
        kept = kept.unionByName(own.join(near, "id", "left_anti"))
    return kept


def label_lines(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Lines (file, line_no, cls, coords) in the 8 classes, the first of equal ones in a file.

    coords is text of x and y of at least three points, each from 0 to 1. A line of an unknown
    class or with other coordinates raises, or is left out unless strict.
    """
    table = F.create_map(*[F.lit(x) for pair in CLASS_MAP.items() for x in pair])
    numbers = F.transform(F.split("coords", " "), lambda x: x.try_cast("double"))
    fine = (F.size(numbers) >= 6) & (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda x: F.coalesce(x.between(0, 1) & ~F.isnan(x), F.lit(False)))
    mapped = lines.withColumn("mapped", F.try_element_at(table, F.col("cls").cast("int"))).withColumn("fine", F.coalesce(F.col("mapped").isNotNull() & fine, F.lit(False)))
    if strict:
        name = F.concat_ws(":", F.col("file").cast("string"), F.col("line_no").cast("string"))
        mapped = mapped.withColumn("mapped", F.when(F.col("fine"), F.col("mapped")).otherwise(F.raise_error(F.concat(F.lit("invalid label line "), name))))
    else:
        mapped = mapped.filter("fine")
    mapped = mapped.drop("fine")
    text = mapped.withColumn("line", F.concat_ws(" ", F.col("mapped").cast("string"), "coords"))
    once = Window.partitionBy("file", "line").orderBy("line_no")
    return text.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n")


def sampled_by_hash(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows of each group, least sha256 of the key first: a seeded shuffle that is equal on every run."""
    h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col(key).cast("string")), 256)
    return df.withColumn("h", h).withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("h", key))).filter(F.col("n") <= n).drop("h", "n")
