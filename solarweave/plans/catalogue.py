"""Queries on sources, status, caches and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.functions.boxes import ring_area
from solarweave.operators import raster, status
from solarweave.plans.fixtures import RASTER_SQL, fixture, fixture_sql
from solarweave.plans.rasters import _grid
from solarweave.sources import files, keys, pages
from solarweave.storage import table


def request_cache_key(spark, sf_dir):
    """Cache key of a request for each page: url and sorted parameters."""
    p = table(spark, sf_dir, "pages")
    params = F.create_map(F.lit("sr"), F.lit("2056"), F.lit("layer"), F.col("page_id").cast("string"))
    return p.select("page_id", keys.request_key(F.col("url"), params).alias("cache_key"))


def strip_markup(spark, sf_dir):
    """Size and digest of each page's text without tags."""
    p = table(spark, sf_dir, "pages").withColumn("t", keys.plain_text(F.col("html")))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("digest"))


def search_top5(spark, sf_dir):
    """The first five pages for each search of 3 to 150 letters, by url, with their place."""
    terms = table(spark, sf_dir, "region").select(F.element_at(F.array(*map(F.lit, ("example.org", "/en/", "ex", "<b>x", "/de/1"))), (F.col("r_regionkey") + 1).cast("int")).alias("term"))
    entries = table(spark, sf_dir, "pages").select(F.concat(F.lit("<b>"), F.coalesce("url", F.lit("")), F.lit("</b>")).alias("label"), (7.0 + F.col("page_id") % 100 / 64).alias("lon"), (46.0 + F.col("page_id") % 64 / 64).alias("lat"))
    return status.best_matches(entries, terms)


def cached_responses(spark, sf_dir):
    """Which responses may be kept in the cache: successful, and without an error inside."""
    p = table(spark, sf_dir, "part")
    bodies = F.array(*map(F.lit, ('{"results": []}', '{"error": {"code": 400}}', '{"results"', "")))
    body = F.when(F.col("p_partkey") % 5 == 4, F.unhex(F.lit("89504E470D0A"))).otherwise(F.element_at(bodies, (F.col("p_partkey") % 5 % 4 + 1).cast("int")).cast("binary"))
    return p.select("p_partkey", pages.storable(F.when(F.col("p_partkey") % 7 == 0, 500).otherwise(200), body, F.col("p_partkey") % 5 == 4).alias("keep"))


def latest_per_tile(spark, sf_dir):
    """The newest half-metre TIFF of each origin."""
    t = fixture(spark, sf_dir, "tiles").filter("name like '%.tif' and contains(name, '_0.5_')")
    return status.newest_tiles(t, "origin", "ts", "id").select("origin", "id", "name")


def bounded_tiles(spark, sf_dir):
    """The tiles of 16 m that each part of a house touches within 10 m, four at most."""
    p = fixture(spark, sf_dir, "parts")
    tiles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 5 * 16.0).alias("east"), (F.floor(F.col("n_nationkey") / 5) * 16.0).alias("north"))
    requests = p.select(F.col("id").alias("request"), *((F.col(c) + d).alias(c) for c, d in (("x1", -10), ("y1", -10), ("x2", 10), ("y2", 10))))
    return status.tiles_of_window(tiles, requests, 16.0)


def cache_eviction(spark, sf_dir):
    """Files that a budget of 300 bytes a folder keeps, newest first."""
    return status.evicted(fixture(spark, sf_dir, "files"), "folder", ["mtime", "id"], "size", 300).select("id", "folder", "with_newer", "kept")


def page_offsets(spark, sf_dir):
    """Offset of the page of 40 that holds each file of a folder."""
    return status.pages_of(fixture(spark, sf_dir, "files"), "folder", ["id"], 40).select("id", "folder", "offset")


def paged_survey(spark, sf_dir):
    """Records of each folder's survey, read page by page up to the page that ends it."""
    f = fixture(spark, sf_dir, "files").withColumn("offset", (F.floor(F.col("id") % 20 / 4) * 4).cast("long"))
    item = F.struct(F.col("id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.col("size").cast("double").alias("x2"), F.lit(1.0).alias("y2"))
    grouped = f.groupBy("folder", "offset").agg(F.array_sort(F.collect_list(item)).alias("features"))
    text = F.to_json(F.struct("offset", F.lit(pages.SYSTEM).alias("crs"), (F.col("offset") < (F.col("folder") % 5) * 4).alias("exceededTransferLimit"), (F.col("folder") % 11 == 0).alias("outside"), "features"))
    own = grouped.select("folder", F.from_json(text, pages.PAGE).alias("page"))
    return pages.survey_records(own, "folder").select("folder", "offset", "last", "id", F.col("x2").cast("long").alias("size"))


def status_records(spark, sf_dir):
    """The last known state of each model from records of JSON, some of them broken."""
    s = fixture(spark, sf_dir, "states")
    text = F.when(F.col("id") % 6 == 5, F.lit('{"state": "fai')).otherwise(F.format_string('{"state": "%s", "epoch": 3}', F.coalesce("state", F.lit("idle"))))
    return status.last_known(s.withColumn("parsed", keys.parsed_status(text)), "model", ["ts", "id"], "parsed").select("id", "model", "known")


def geopackage_geometry(spark, sf_dir):
    """Area and corners of polygons decoded from geometry blobs with headers of several lengths."""
    p = table(spark, sf_dir, "part")
    sizes = F.array(*map(F.lit, ("000000000000F03F", "0000000000000040", "0000000000001040", "0000000000002040")))
    x, y, zero = F.element_at(sizes, (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(sizes, (F.col("p_size") % 4 + 1).cast("int")), F.lit("0" * 16)
    header = F.concat(F.lit("475000"), F.when(F.col("p_partkey") % 3 == 0, F.lit("0108080000")).otherwise(F.concat(F.lit("0308080000"), F.lit("00" * 32))))
    blob = F.unhex(F.concat(header, F.lit("01030000000100000005000000"), zero, zero, x, zero, x, y, zero, y, zero, zero))
    ring = keys.wkb_polygon(F.when(F.col("p_partkey") % 13 == 0, F.unhex(F.lit("475000"))).otherwise(blob))[0]
    return p.withColumn("ring", ring).select("p_partkey", F.size("ring").alias("points"), F.when(F.col("ring").isNotNull(), ring_area(F.col("ring"))).alias("area"))


def mosaic_windows(spark, sf_dir):
    """Heights of windows of a mosaic: snapped to the grid, the first tile with a value wins."""
    g = _grid(spark, sf_dir)
    step = F.col("image") % 50
    tiles = g.select(F.col("image").alias("rank"), (F.col("r") + F.floor(step / 10) * 4).alias("r"), (F.col("c") + (step % 10) * 4).alias("c"), F.when(F.col("z") > -0.1, F.col("z")).otherwise(F.lit(float("nan"))).alias("z"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request"), (F.col("n_nationkey") % 5 * 3 + 0.2).alias("x1"), (-6.3 - F.col("n_nationkey") % 4).alias("y1"))
    return raster.mosaic_windows(n.select("*", (F.col("x1") + 3.1).alias("x2"), (F.col("y1") + 2.6).alias("y2")), tiles)


def last_known_status(spark, sf_dir):
    """The last state that isn't null of each model, at each event."""
    return status.last_known(fixture(spark, sf_dir, "states"), "model", ["ts", "id"], "state").select("id", "model", "known")


def latest_request_wins(spark, sf_dir):
    """The last turn of each conversation and role."""
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long")).withColumn("tie", F.sha2("text", 256))
    return status.latest(c, "conv_id", ["turn", "role", "tie"]).select("conv_id", "turn", "role", "size")


def ordered_distinct(spark, sf_dir):
    """Kinds of events with the first event of each."""
    return status.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


def coverage_status(spark, sf_dir):
    """What each model's states mean, counted, and whether its answer is provisional."""
    s = fixture(spark, sf_dir, "states")
    c = status.coverage(F.col("state"))
    return s.groupBy("model").agg(*(F.count_if(c == k).alias(k) for k in ("checked", "not_applicable", "unavailable")), status.provisional(F.col("available"), F.col("state")).alias("provisional"))


def independent_thresholds(spark, sf_dir):
    """Detections that pass their model's own threshold; rid panels go, as the swiss model is ready."""
    d = fixture(spark, sf_dir, "boxes")
    least = F.when((F.col("source") == "rid") & (F.col("kind") != "pv_installation"), 0.3).otherwise(0.25)
    return d.filter((F.col("confidence") >= least) & ~((F.col("source") == "rid") & (F.col("kind") == "pv_installation"))).groupBy("source", "kind").agg(F.count("*").alias("n"), F.min("confidence").alias("least"))


def request_ranges(spark, sf_dir):
    """Requests whose parameters are in range, and the values that the form would clamp them to."""
    s = fixture(spark, sf_dir, "scores")
    setback, gap = F.col("shift"), F.col("rival") / 20
    asked = {"lat": 45.0 + F.col("id") % 40 / 10, "lon": 5.0 + F.col("id") % 70 / 10, "confidence": F.col("id") % 100 / 100, "setback": setback, "row_gap": gap}
    return s.select("id", status.valid_request(asked).alias("valid"), F.least(F.lit(2.0), F.greatest(F.lit(0.3), setback)).alias("clamped"), (F.col("support") * 4 <= 14).alias("base_layer"))


def chip_metadata(spark, sf_dir):
    """Year and place in the names of chips, and origins in those of tiles."""
    c = fixture(spark, sf_dir, "chips")
    name = F.concat(F.lit("chip_"), (2000 + F.col("id") % 24).cast("string"), F.lit("_"), F.format_string("%.3f", (2600000 + F.col("x")) / 1000), F.lit("-"), F.format_string("%.3f", (1200000 + F.col("y")) / 1000), F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.lit("_a")))
    tile = F.concat(F.lit("swissalti_"), F.when(F.col("id") % 7 == 0, F.lit("none")).otherwise(F.concat((2600 + F.col("id") % 90).cast("string"), F.lit("-1247"))), F.lit("_0.5.tif"))
    both = c.withColumn("m", keys.chip_name(name)).withColumn("o", keys.tile_origin(tile))
    return both.select("id", "m.year", "m.x", "m.y", "o.east", "o.north")


def archive_members(spark, sf_dir):
    """Members of archives and listings that may be taken."""
    p = table(spark, sf_dir, "part")
    path = F.concat(F.element_at(F.array(F.lit("images/"), F.lit("../images/"), F.lit("/masks/"), F.lit("labels/../../"), F.lit("other/")), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit(".exe")).otherwise(F.lit(".PNG")))
    return p.select("p_partkey", keys.safe_member(path).alias("safe"), keys.data_file(path, F.col("p_partkey") % 4 == 0).alias("data"))


def geopackage_header(spark, sf_dir):
    """Where the WKB begins in a geometry blob, by the envelope code of its header."""
    p = table(spark, sf_dir, "part")
    blob = F.unhex(F.concat(F.lit("475000"), F.lpad(F.hex((F.col("p_partkey") % 6) * 2 + 1), 2, "0"), F.lit("08080000")))
    return p.select("p_partkey", keys.wkb_offset(blob).cast("long").alias("wkb_at"))


def gate_files(spark, sf_dir):
    """Gate files that count, given as SYSTEM=JSON: exact thresholds and passed, with the digest that is recorded."""
    p = table(spark, sf_dir, "part")
    text = F.format_string('{"parameters": {"confidence": %s, "obstacle_confidence": 0.3}, "quality_gates": {"passed": %s}}', F.when(F.col("p_partkey") % 3 == 0, "0.25").otherwise("0.2"), F.when(F.col("p_partkey") % 2 == 0, "true").otherwise("false"))
    argument = F.concat(F.element_at(F.array(F.lit("production"), F.lit("candidate")), (F.col("p_partkey") % 2 + 1).cast("int")), F.lit("="), text)
    return p.select("p_partkey", keys.system_gate(argument, ("production", "candidate")).alias("g")).select("p_partkey", "g.system", F.col("g.gate").alias("counts"), "g.digest")


def report_rows(spark, sf_dir):
    """Lines of a report table and a feature of GeoJSON for each order's first box."""
    b = fixture(spark, sf_dir, "order_boxes").filter("seq = 1")
    line = files.report_row("analysis", "x1", "y2")
    return b.select("analysis", line.alias("line"), files.feature(F.col("kind"), *(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("feature"))


QUERIES = {f.__name__: f for f in (bounded_tiles, cached_responses, status_records, geopackage_geometry, mosaic_windows, request_cache_key, strip_markup, search_top5, latest_per_tile, cache_eviction, page_offsets, paged_survey, last_known_status, latest_request_wins, ordered_distinct, coverage_status, independent_thresholds, request_ranges, chip_metadata, archive_members, geopackage_header, gate_files, report_rows)}

_NAME = "'chip_' || (2000 + id % 24)::VARCHAR || '_' || printf('%.3f', (2600000 + x) / 1000) || '-' || printf('%.3f', (1200000 + y) / 1000)"
SQL = {
    "request_cache_key": """SELECT page_id, sha256(url || '{"layer": "' || page_id::VARCHAR || '", "sr": "2056"}') AS cache_key FROM pages""",
    "strip_markup": "SELECT page_id, length(t) AS n, sha256(t) AS digest FROM (SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS t FROM pages)",
    "search_top5": """WITH terms AS (SELECT ['example.org', '/en/', 'ex', '<b>x', '/de/1'][r_regionkey + 1] AS term FROM region), e AS (SELECT '<b>' || coalesce(url, '') || '</b>' AS l, 7.0::DOUBLE + page_id % 100 / 64 AS lon, 46.0::DOUBLE + page_id % 64 / 64 AS lat FROM pages)
SELECT term, place, regexp_replace(l, '<[^>]+>', '', 'g') AS label, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY l, lon, lat)::INTEGER AS place FROM e JOIN terms ON contains(l, term) WHERE length(term) >= 3) WHERE place <= 5""",
    "bounded_tiles": f"""WITH t AS (SELECT n_nationkey::BIGINT AS id, n_nationkey % 5 * 16.0::DOUBLE AS e, n_nationkey // 5 * 16.0::DOUBLE AS n FROM nation), p AS ({fixture_sql("parts")})
SELECT p.id AS request, t.id, row_number() OVER (PARTITION BY p.id ORDER BY e, n, t.id)::INTEGER AS place FROM p JOIN t ON e + 16 > x1 - 10 AND e <= x2 + 10 AND n + 16 > y1 - 10 AND n <= y2 + 10 QUALIFY place <= 4""",
    "cached_responses": "SELECT p_partkey, p_partkey % 7 <> 0 AND p_partkey % 5 IN (0, 4) AS keep FROM part",
    "latest_per_tile": f"SELECT origin, id, name FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY ts DESC, id DESC) AS n FROM ({fixture_sql('tiles')}) WHERE name LIKE '%.tif' AND contains(name, '_0.5_')) WHERE n = 1",
    "cache_eviction": f"SELECT id, folder, w::BIGINT AS with_newer, w <= 300 AS kept FROM (SELECT *, sum(size) OVER (PARTITION BY folder ORDER BY mtime, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM ({fixture_sql('files')}))",
    "page_offsets": f"SELECT id, folder, (row_number() OVER (PARTITION BY folder ORDER BY id) - 1) // 40 * 40 AS \"offset\" FROM ({fixture_sql('files')})",
    "paged_survey": f"""SELECT folder, o AS "offset", o = (folder % 5) * 4 AS last, id, size FROM (SELECT *, id % 20 // 4 * 4 AS o FROM ({fixture_sql("files")})) WHERE o <= (folder % 5) * 4 AND folder % 11 <> 0""",
    "status_records": f"""SELECT id, model, last_value(p IGNORE NULLS) OVER (PARTITION BY model ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM (SELECT *, CASE WHEN id % 6 <> 5 THEN coalesce(state, 'idle') END AS p FROM ({fixture_sql("states")}))""",
    "geopackage_geometry": "SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN 5 END AS points, CASE WHEN p_partkey % 13 <> 0 THEN [1, 2, 4, 8][p_partkey % 4 + 1] * [1, 2, 4, 8][p_size % 4 + 1] END::DOUBLE AS area FROM part",
    "mosaic_windows": f"""WITH t AS (SELECT image, r + (image % 50) // 10 * 4 AS r, c + image % 10 * 4 AS c, z FROM ({RASTER_SQL}) WHERE z > -0.1), m AS (SELECT r, c, arg_min(z, image) AS z FROM t GROUP BY ALL),
q AS (SELECT n_nationkey AS request, n_nationkey % 5 * 3 + 0.2::DOUBLE AS x1, -6.3::DOUBLE - n_nationkey % 4 AS y1 FROM nation),
w AS (SELECT request, floor(x1 * 2)::BIGINT AS c1, ceil((x1 + 3.1::DOUBLE) * 2)::BIGINT AS c2, -ceil((y1 + 2.6::DOUBLE) * 2)::BIGINT AS r1, -floor(y1 * 2)::BIGINT AS r2 FROM q)
SELECT request, r - r1 AS r, c - c1 AS c, z FROM w JOIN m ON r >= r1 AND r < r2 AND c >= c1 AND c < c2""",
    "last_known_status": f"SELECT id, model, last_value(state IGNORE NULLS) OVER (PARTITION BY model ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM ({fixture_sql('states')})",
    "latest_request_wins": "SELECT conv_id, turn, role, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, sha256(text) DESC) AS n FROM conversations) WHERE n = 1",
    "ordered_distinct": "SELECT event_type, min(event_id) AS first_seen FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "coverage_status": f"""SELECT model, count(*) FILTER (state = 'ready') AS checked, count(*) FILTER (state = 'outside_coverage') AS not_applicable, count(*) FILTER (state IS NULL OR state = 'failed') AS unavailable,
  NOT bool_and(available) OR bool_or(state IS NULL OR state = 'failed') AS provisional FROM ({fixture_sql("states")}) GROUP BY model""",
    "independent_thresholds": f"""SELECT source, kind, count(*) AS n, min(confidence) AS least FROM ({fixture_sql("boxes")})
WHERE confidence >= CASE WHEN source = 'rid' AND kind <> 'pv_installation' THEN 0.3::DOUBLE ELSE 0.25::DOUBLE END AND NOT (source = 'rid' AND kind = 'pv_installation') GROUP BY ALL""",
    "request_ranges": f"""SELECT id, coalesce(shift BETWEEN 0.3::DOUBLE AND 2 AND rival / 20 BETWEEN 0.2::DOUBLE AND 2 AND 45 + id % 40 / 10 BETWEEN 45.7::DOUBLE AND 47.9::DOUBLE AND 5 + id % 70 / 10 BETWEEN 5.9::DOUBLE AND 10.6::DOUBLE AND id % 100 / 100 BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE, FALSE) AS valid, least(2.0::DOUBLE, greatest(0.3::DOUBLE, shift)) AS clamped, support * 4 <= 14 AS base_layer FROM ({fixture_sql("scores")})""",
    "chip_metadata": f"""SELECT id, regexp_extract(n, '_(\\d{{4}})_', 1)::INTEGER AS year, round(regexp_extract(n, '_(\\d+\\.\\d+)-', 1)::DOUBLE * 1000)::BIGINT AS x, round(regexp_extract(n, '-(\\d+\\.\\d+)', 1)::DOUBLE * 1000)::BIGINT AS y,
  CASE WHEN id % 7 <> 0 THEN (2600 + id % 90) * 1000 END AS east, CASE WHEN id % 7 <> 0 THEN 1247000::BIGINT END AS north FROM (SELECT *, {_NAME} AS n FROM ({fixture_sql("chips")}))""",
    "archive_members": "SELECT p_partkey, p_partkey % 5 = 0 AND p_partkey % 3 <> 0 AS safe, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AS data FROM part",
    "geopackage_header": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 40 WHEN 2 THEN 56 WHEN 3 THEN 56 WHEN 4 THEN 72 END::BIGINT AS wkb_at FROM part",
    "gate_files": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'production' ELSE 'candidate' END AS system, p_partkey % 6 = 0 AS counts,
  sha256('{"parameters": {"confidence": ' || CASE WHEN p_partkey % 3 = 0 THEN '0.25' ELSE '0.2' END || ', "obstacle_confidence": 0.3}, "quality_gates": {"passed": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}}') AS digest FROM part""",
    "report_rows": f"""SELECT analysis, '| ' || analysis::VARCHAR || ' | ' || printf('%.3f', x1) || ' | ' || printf('%.3f', y2) || ' |' AS line,
  '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || '[' || x1 || ',' || y1 || '],[' || x2 || ',' || y1 || '],[' || x2 || ',' || y2 || '],[' || x1 || ',' || y2 || '],[' || x1 || ',' || y1 || ']]]}},"properties":{{"kind":"' || kind || '"}}}}' AS feature
  FROM ({fixture_sql("order_boxes")}) WHERE seq = 1""",
}
