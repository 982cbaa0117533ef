"""Time-driven state: last known status, latest request, cache eviction, coverage of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.sources.keys import plain_text


def last_known(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """events with known: the latest value that isn't null, up to and with each row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("known", F.last(value, ignorenulls=True).over(w))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key; order decides and must be unique in a key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return events.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def first_seen(events: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the order at which each came first."""
    return events.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first_seen"))


def evicted(files: DataFrame, folder: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Files with kept: the newest of a folder whose sizes together stay within the budget."""
    w = Window.partitionBy(folder).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return files.withColumn("with_newer", F.sum(size).over(w)).withColumn("kept", F.col("with_newer") <= budget)


def pages_of(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """rows with offset: where the page of size rows begins that holds the row."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("offset", F.floor((F.row_number().over(w) - 1) / size) * size)


#: Fixed value: height tiles that one analysis reads at most.
MOST_TILES = 4


def tiles_of_window(tiles: DataFrame, requests: DataFrame, side: float = 1000.0, most: int = MOST_TILES) -> DataFrame:
    """(request, id, place): tiles of that side, by origin (east, north), that a request's box touches; the first four by origin.

    requests are (request, box). A tile is one cell of the grid, so the join is by cell.
    """
    steps = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}1") / side), F.floor(F.col(f"{k}2") / side)))
    asked = requests.select("request", "y1", "y2", steps("x").alias("cell_x")).select("request", "cell_x", steps("y").alias("cell_y"))
    own = tiles.select("id", "east", "north", F.floor(F.col("east") / side).alias("cell_x"), F.floor(F.col("north") / side).alias("cell_y"))
    w = Window.partitionBy("request").orderBy("east", "north", "id")
    return asked.join(own, ["cell_x", "cell_y"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("request", "id", "place")


def best_matches(entries: DataFrame, terms: DataFrame, n: int = 5) -> DataFrame:
    """(term, place, label, lon, lat): for each term of 3 to 150 characters the first n entries that hold it, by label.

    terms is a small table of searches, entries are (label, lon, lat); labels lose their markup.
    """
    asked = terms.filter(F.length("term").between(3, 150)).select("term")
    met = entries.join(F.broadcast(asked), F.contains("label", "term"))
    w = Window.partitionBy("term").orderBy("label", "lon", "lat")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("term", "place", plain_text(F.col("label")).alias("label"), "lon", "lat")


def newest_tiles(tiles: DataFrame, origin: str, time: str, tie: str) -> DataFrame:
    """The newest tile of each origin."""
    w = Window.partitionBy(origin).orderBy(F.desc(time), F.desc(tie))
    return tiles.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


#: Ranges of an analysis request's parameters.
RANGES = {"lat": (45.7, 47.9), "lon": (5.9, 10.6), "confidence": (0.1, 0.9), "setback": (0.3, 2.0), "row_gap": (0.2, 2.0)}


def valid_request(values: dict[str, Column]) -> Column:
    """Whether all parameters are there and in range."""
    out = F.lit(True)
    for name, (low, high) in RANGES.items():
        out = out & values[name].between(low, high)
    return F.coalesce(out, F.lit(False))


def coverage(state: Column) -> Column:
    """What a source's state means for the answer; no state at all is unavailable, never clear."""
    return F.when(state == "ready", "checked").when(state == "outside_coverage", "not_applicable").otherwise("unavailable")


def provisional(ready: Column, source_state: Column) -> Column:
    """Aggregate: whether an answer is provisional, as a model isn't ready or a source is unavailable."""
    return ~F.bool_and(F.coalesce(ready, F.lit(False))) | F.bool_or(coverage(source_state) == "unavailable")
