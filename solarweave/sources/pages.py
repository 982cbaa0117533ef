"""Responses of paged and cached services that are kept as documents: which count, and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solarweave.storage import joined_back

#: Records of a page, the last offset that is asked for, and the reference system of a survey.
STEP, LAST_OFFSET, SYSTEM = 4000, 200_000, "EPSG:2056"
PAGE = "struct<offset:bigint,crs:string,exceededTransferLimit:boolean,outside:boolean,features:array<struct<id:bigint,x1:double,y1:double,x2:double,y2:double>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(survey, page) of a folder's JSON documents, one page each; the survey is a document's folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return raw.select(F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1).alias("survey"), F.from_json("value", PAGE).alias("page"))


def survey_records(pages: DataFrame, key: str = "survey") -> DataFrame:
    """(key, offset, last, id, x1, y1, x2, y2): the records of each survey's pages up to its end.

    pages are (key, page) with page as PAGE says. A survey ends with its first page that
    doesn't say there is more; what lies beyond, or past the last offset, isn't read. A page
    that is empty though it says there is more raises, and so does another reference system.
    Pages outside the survey's extent hold no records.
    """
    own = pages.select(key, "page.*").filter(F.col("offset") <= LAST_OFFSET)
    more = F.coalesce("exceededTransferLimit", F.lit(False))
    ends = own.groupBy(key).agg(F.min(F.when(~more, F.col("offset"))).alias("end"))
    read = joined_back(own, ends, key).filter(F.col("end").isNull() | (F.col("offset") <= F.col("end")))
    empty = F.coalesce(F.size("features"), F.lit(0)) <= 0
    why = F.when(F.col("crs") != SYSTEM, "reference system").when(empty & more & ~F.coalesce("outside", F.lit(False)), "empty page with more to come")
    read = read.filter(F.when(why.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("survey page: "), why)).cast("boolean")))
    return read.filter(~F.coalesce("outside", F.lit(False))).select(key, "offset", (F.col("offset") == F.col("end")).alias("last"), F.inline("features"))


def storable(status: Column, body: Column, is_image: Column) -> Column:
    """Whether a response may be cached: it succeeded, and is a JSON object or list without "error" as key or element, or starts as a PNG or JPEG."""
    text = body.cast("string")
    whole = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*[{\[]")
    refused = F.coalesce(F.map_contains_key(F.from_json(text, "map<string,string>"), F.lit("error")), F.lit(False)) | F.coalesce(F.array_contains(F.from_json(text, "array<string>"), "error"), F.lit(False))
    picture = F.hex(F.substring(body, 1, 4)).isin("89504E47") | F.hex(F.substring(body, 1, 3)).isin("FFD8FF")
    return F.coalesce((status == 200) & F.when(is_image, picture).otherwise(whole & ~refused), F.lit(False))
