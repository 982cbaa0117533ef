"""Files in and out: image and mask pairs, GeoTIFF tags, label lines, manifests, reports."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most segments of a JPEG that are looked through for its frame header.
JPEG_SEGMENTS = 512


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(stem, path, content, digest) of the files that match."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return df.select(stem.alias("stem"), "path", "content", F.sha2("content", 256).alias("digest"))


def png_size(content: Column) -> Column:
    """Struct width, height of a PNG's header; null for another format."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_size(content: Column) -> Column:
    """Struct width, height of a JPEG's frame header, found from segment to segment; null for another format or without a frame.

    A frame that follows more than JPEG_SEGMENTS other segments isn't found.
    """
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")

    def step(s: Column, _: Column) -> Column:
        at, marker = s["at"], number(s["at"], 2)
        frame = marker.between(0xFFC0, 0xFFCF) & ~marker.isin(0xFFC4, 0xFFC8, 0xFFCC)
        bare = (marker == 0xFF01) | marker.between(0xFFD0, 0xFFD7)
        nothing = F.lit(None).cast("int")
        to = lambda at, w, h: F.struct(at.alias("at"), w.alias("width"), h.alias("height"))
        return (
            F.when(at == 0, s).when(marker == 0xFFFF, to(at + 1, nothing, nothing)).when(frame, to(F.lit(0), number(at + 7, 2), number(at + 5, 2))).when(bare, to(at + 2, nothing, nothing))
            .when((marker > 0xFF00) & ~marker.isin(0xFFD9, 0xFFDA) & (number(at + 2, 2) >= 2), to(at + 2 + number(at + 2, 2), nothing, nothing)).otherwise(to(F.lit(0), nothing, nothing))
        )

    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), start, step)
    return F.when((F.hex(F.substring(content, 1, 2)) == "FFD8") & found["width"].isNotNull(), F.struct(found["width"].cast("long").alias("width"), found["height"].cast("long").alias("height")))


def image_size(content: Column) -> Column:
    """Struct width, height of a PNG or JPEG; null for another format."""
    return F.coalesce(png_size(content), jpeg_size(content))


def paired(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images with their masks by stem; raises on one that lacks the other, and where sizes differ. Only sizes of PNG and JPEG files are known."""
    i, m = images.select("stem", F.col("content").alias("image")), masks.select("stem", F.col("content").alias("mask"))
    both = i.join(m, "stem", "full_outer")
    same = F.coalesce(image_size(F.col("image")) == image_size(F.col("mask")), F.lit(True))
    wrong = F.when(F.col("image").isNull() | F.col("mask").isNull(), "no pair for ").when(~same, "sizes differ for ")
    return both.withColumn("stem", F.when(wrong.isNull(), F.col("stem")).otherwise(F.raise_error(F.concat(wrong, "stem"))))


def required_tags(tags: DataFrame, pixels: int = 10_000, scale: float = 0.1) -> DataFrame:
    """tags (see geotiff_tags) as they are; raises on a tile that isn't 10000 x 10000 pixels of 0.1 m or lacks its origin."""
    fine = (F.col("width") == pixels) & (F.col("height") == pixels) & (F.abs(F.col("scale_x") - scale) < 1e-9) & (F.abs(F.col("scale_y") - scale) < 1e-9) & F.col("east").isNotNull() & F.col("north").isNotNull()
    return tags.withColumn("stem", F.when(F.coalesce(fine, F.lit(False)), F.col("stem")).otherwise(F.raise_error(F.concat(F.lit("not a tile of the survey: "), "stem"))))


def _tags(content: bytes) -> dict | None:
    """Width, height, pixel scale and origin of a GeoTIFF's first directory; None if it is no TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack(order + "H", content[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", content[4:8])[0]
    kinds, found = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8)}, {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in kinds:
            code, size = kinds[kind]
            place = at + 10 + 12 * k if n * size <= 4 else struct.unpack(order + "I", content[at + 10 + 12 * k : at + 14 + 12 * k])[0]
            found[tag] = struct.unpack(f"{order}{n}{code}", content[place : place + n * size])
    scale, tie = found.get(33550, (None, None)), found.get(33922, (0, 0, 0, None, None))
    return {"width": found.get(256, (None,))[0], "height": found.get(257, (None,))[0], "scale_x": scale[0], "scale_y": scale[1], "east": tie[3], "north": tie[4]}


def geotiff_tags(files: DataFrame) -> DataFrame:
    """files with width, height, scale_x, scale_y, east and north from their tags; null for what is no TIFF."""
    names = ("width", "height", "scale_x", "scale_y", "east", "north")

    def run(batches):
        for batch in batches:
            got = [_tags(c) or {} for c in batch.column("content").to_pylist()]
            kinds = (pa.int64(), pa.int64(), *(pa.float64(),) * 4)
            yield pa.RecordBatch.from_arrays([batch.column("stem"), *(pa.array([g.get(n) for g in got], k) for n, k in zip(names, kinds, strict=True))], ["stem", *names])

    return files.select("stem", "content").mapInArrow(run, "stem string, width long, height long, scale_x double, scale_y double, east double, north double")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, cls, points, valid) of label lines `class x1 y1 ...`: three points or more, all from 0 to 1."""
    lines = spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)).filter("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    points = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.try_cast("double"))
    fine = (F.size(points) >= 6) & (F.size(points) % 2 == 0) & F.forall(points, lambda p: F.coalesce(p.between(0, 1), F.lit(False)))
    cls = parts[0].try_cast("int")
    return lines.select("file", cls.alias("cls"), points.alias("points"), (fine & cls.isNotNull()).alias("valid"))


def write_manifests(chips: DataFrame, path: str) -> None:
    """One folder of text for each split, a file name a line."""
    chips.select("split", F.col("name").cast("string").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label lines (split, file, line) as text: a folder for each split, one for each file in it."""
    lines.select("split", "file", F.col("line").alias("value")).repartition("split", "file").write.mode("overwrite").partitionBy("split", "file").text(path)


def dataset_yaml(classes: tuple[str, ...], root: str = ".", splits: tuple[str, ...] = ("train", "val", "test")) -> str:
    """A data set's description: its root, the manifest of each split, and the class names by number."""
    return "\n".join([f"path: {root}", *(f"{s}: split={s}" for s in splits), "names:", *(f"  {i}: {name}" for i, name in enumerate(classes))])


def write_yaml(spark: SparkSession, classes: tuple[str, ...], path: str) -> None:
    spark.createDataFrame([(dataset_yaml(classes),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def audit(rows: DataFrame) -> DataFrame:
    """One row: images, groups, instances, least and mean agreement, and how many images each split has."""
    return rows.agg(
        F.count("*").alias("images"), F.count_distinct("group").alias("groups"), F.sum("instances").alias("instances"), F.min("conversion_iou").alias("least_iou"), F.avg("conversion_iou").alias("mean_iou"),
        F.struct(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test"))).alias("splits"),
    )


def write_audit(rows: DataFrame, path: str) -> None:
    """The audit rows as JSON lines, and their summary beside them."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    audit(rows).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def report_row(name: str, *columns: str):
    """A line of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", F.col(name).cast("string"), *(F.format_string("%.3f", F.col(c).cast("double")) for c in columns)), F.lit(" |"))


def feature(kind, x1, y1, x2, y2):
    """GeoJSON of a box as a Feature."""
    ring = F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2), F.array(x1, y1))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(kind.alias("kind")).alias("properties")))
