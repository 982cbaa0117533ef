"""Queries on detections and data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from solarweave.operators import curation, evaluation, fusion
from solarweave.operators.spatial import BOX, common_part, overlap_join, union_area
from solarweave.plans.fixtures import SOURCES_SQL, fixture, fixture_sql, sourced
from solarweave.storage import stored, table

CELL = 4.0


def alias_normalise(spark, sf_dir):
    """Valid detections with the kind that their name means, and model and source filled in."""
    return fusion.normalised(fixture(spark, sf_dir, "raw_detections")).select("id", "kind", "label", "confidence", "source", "model")


def provenance_merge_keyed(spark, sf_dir):
    """Detections of one analysis and kind as one, with the best source's claim and all sources."""
    return fusion.merged_by_key(fusion.normalised(fixture(spark, sf_dir, "raw_detections")), "analysis", "kind")


def merge_order(spark, sf_dir):
    """The turn of each detection in the merge of its analysis."""
    d = fusion.normalised(fixture(spark, sf_dir, "raw_detections"))
    return fusion.in_order(d, "analysis").select("id", "analysis", "place")


def kind_source_summary(spark, sf_dir):
    """Count and area of each kind and source."""
    return fusion.summary(fusion.normalised(fixture(spark, sf_dir, "raw_detections")))


def overlap_pairs(spark, sf_dir):
    """Detections of one kind that share more than half of the smaller one's area."""
    return fusion.same_kind_pairs(fixture(spark, sf_dir, "boxes"), CELL)


def trusted_pv_arbitration_boxes(spark, sf_dir):
    """What is left of each detection where trusted panels take from single-model obstacles."""
    d = sourced(fixture(spark, sf_dir, "boxes"))
    return fusion.arbitrated(d, CELL).select("id", "kind", F.concat_ws(",", "sources").alias("sources"), "clipped_area", "blocks_placement")


def box_union_area(spark, sf_dir):
    """Area that an order's boxes cover together."""
    return union_area(fixture(spark, sf_dir, "order_boxes"), "analysis", size=CELL)


def greedy_merge(spark, sf_dir):
    """Sequential merge of each analysis and kind, in the order of confidence."""
    return fusion.greedy_merge(fixture(spark, sf_dir, "order_boxes"))


def image_class_summary(spark, sf_dir):
    """Masks of each image and label: count, areas, best confidence and sources."""
    out = evaluation.image_summary(_masks(spark, sf_dir), 64.0, CELL)
    return out.select("image", "label", "mask_count", "total_area", "largest_area", "max_confidence", F.concat_ws(",", "sources").alias("sources"), "total_fraction", "largest_fraction")


def _masks(spark, sf_dir):
    return sourced(fixture(spark, sf_dir, "order_boxes")).withColumnsRenamed({"analysis": "image", "kind": "label"})


def swiss_rid_overlap(spark, sf_dir):
    """Where swiss panels and rid obstacles of an image overlap: area, share of the image and of the panels."""
    return evaluation.swiss_against_rid(_masks(spark, sf_dir), 64.0, CELL)


def largest_rid_fraction(spark, sf_dir):
    """The largest mask among the obstacle labels of each image that rid saw, as a share of the image."""
    return evaluation.largest_rid_fraction(evaluation.image_summary(_masks(spark, sf_dir), 64.0, CELL))


def source_fallback(spark, sf_dir):
    """How many detections have each set of sources: their list, else source, else model, else unknown."""
    d = fixture(spark, sf_dir, "raw_detections")
    listed = F.when(F.col("id") % 8 == 0, F.array(F.lit("swiss"), F.lit("rid"), F.lit("swiss")))
    return d.groupBy(F.concat_ws(",", fusion.source_set(listed, F.col("source"), F.col("model"))).alias("sources")).agg(F.count("*").alias("n"))


def source_union(spark, sf_dir):
    """Detections of three sources with different columns as one table: rows, and nulls where a source lacks a column."""
    d = fixture(spark, sf_dir, "boxes")
    parts = [d.filter("source = 'survey'").select("id", "source", "kind"), d.filter("source = 'height'").select("id", "source", "x1"), d.filter("source = 'rid'").select("id", "source", "kind", "confidence")]
    return fusion.all_sources(*parts).groupBy("source").agg(F.count("*").alias("n"), F.count("kind").alias("kinds"), F.count("x1").alias("places"), F.count("confidence").alias("scores"))


def survey_clip(spark, sf_dir):
    """Survey parts clipped to roofs of 10 x 10 m, pieces of 0.15 square metres and more."""
    b = fixture(spark, sf_dir, "boxes").filter("source = 'survey'")
    chips = fixture(spark, sf_dir, "chips").select(F.col("id").alias("roof"), (F.col("x") / 16).alias("x1"), (F.col("y") / 2).alias("y1"), (F.col("x") / 16 + 10).alias("x2"), (F.col("y") / 2 + 10).alias("y2"))
    return fusion.survey_parts(b, chips, 8.0).select("roof", "id", "area")


def detection_parts(spark, sf_dir):
    """Parts of detections with several polygons: area of each, without what covers nothing."""
    d = fixture(spark, sf_dir, "order_boxes")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}
    square, triangle = F.array(pt(c["x1"], c["y1"]), pt(c["x2"], c["y1"]), pt(c["x2"], c["y2"]), pt(c["x1"], c["y2"])), F.array(pt(c["x1"], c["y1"]), pt(c["x2"], c["y1"]), pt(c["x1"], c["y2"]))
    line = F.array(pt(c["x1"], c["y1"]), pt(c["x2"], c["y2"]), pt(c["x1"], c["y1"]))
    return fusion.polygon_parts(d.select("id", F.array(square, line, triangle).alias("polygons"))).select("id", "part", "area")


def clipped_to_roof(spark, sf_dir):
    """Detections clipped to the roof of their analysis (4 x 4 m), slivers left out; blocking ones marked."""
    d = fixture(spark, sf_dir, "order_boxes")
    c = d.select("id", "kind", F.greatest("x1", F.lit(1.0)).alias("x1"), F.greatest("y1", F.lit(1.0)).alias("y1"), F.least("x2", F.lit(4.0)).alias("x2"), F.least("y2", F.lit(4.0)).alias("y2")).filter("x2 > x1 and y2 > y1")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return c.withColumn("area", area).filter("area > 0.01").select("id", "area", fusion.blocks_placement(F.col("kind")).alias("blocks"))


def chip_roof_overlap(spark, sf_dir):
    """Chips of 100 m that roofs cover by at least 100 square metres together, and how much: a join by grid cells."""
    b = fixture(spark, sf_dir, "boxes")
    chips = fixture(spark, sf_dir, "chips").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 100).alias("x2"), (F.col("y") + 100).alias("y2"))
    # chips of one place are answered once: pairs grow with places times roofs, not with chips times roofs
    places = stored(chips.groupBy(*BOX).agg(F.min("id").alias("place")), "places")
    met = stored(common_part(overlap_join(places, b.select("x1", "y1", "x2", "y2"), 50.0), F.col("a_place").alias("place")).groupBy("place", *BOX).agg(F.count("*").alias("n")), "shared")
    found = met.groupBy("place").agg(F.sum("n").alias("n")).join(union_area(met, "place", size=4.0), "place").filter("union_area >= 100")
    there = stored(places.join(found, "place"), "found")
    return chips.join(there, list(BOX)).select(F.col("id").alias("chip"), "n", F.col("union_area").alias("area"))


def hash_split(spark, sf_dir):
    """Documents and customers by split of their key's hash."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("data"), F.floor(F.col("doc_id") / 4).cast("string").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("data"), F.col("c_custkey").cast("string").alias("k"))
    return d.union(c).groupBy("data", curation.split_of(F.col("k")).alias("split")).agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


def exact_dedup_first_wins(spark, sf_dir):
    """Documents with the first one of equal text."""
    out = curation.first_of_each(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), "doc_id")
    return out.select("doc_id", "digest", "duplicate_of", "keep")


def boundary_exclusion(spark, sf_dir):
    """Chips without training ones within 100 m of held-out ones."""
    return curation.excluded_near(fixture(spark, sf_dir, "chips")).select("id", "split")


def chained_exclusion(spark, sf_dir):
    """Validation chips clear of test chips, then training chips clear of both."""
    return curation.excluded_in_turn(fixture(spark, sf_dir, "chips")).select("id", "split")


def priority_overlap_exclusion(spark, sf_dir):
    """Footprints of 36 to 56 m that no kept one of a higher split meets within 2 m: test, then validation, then training."""
    c = fixture(spark, sf_dir, "chips").select("id", "split", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 36 + F.col("id") % 3 * 10).alias("x2"), (F.col("y") + 36 + F.col("id") % 2 * 10).alias("y2"))
    return curation.excluded_overlaps(c).select("id", "split")


def label_remap_dedup(spark, sf_dir):
    """Label lines in the eight classes, each once a file."""
    return curation.label_lines(fixture(spark, sf_dir, "label_lines"), strict=False).select("file", "line_no", "mapped", "line")


def seeded_sample(spark, sf_dir):
    """Eight chips of each split, equal on every run."""
    return curation.sampled_by_hash(fixture(spark, sf_dir, "chips"), "split", "id", 8).select("split", "id")


def _judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.least(F.col("n_chars"), F.lit(4096)) / 4096).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("truth", F.col("quality") == 1)


def confusion_metrics(spark, sf_dir):
    """Confusion and scores of a length rule against the quality labels, by language."""
    d = _judged(spark, sf_dir)
    return evaluation.with_scores(evaluation.confusion(d, F.col("truth"), F.col("score") >= 0.25, "lang"))


def threshold_sweep(spark, sf_dir):
    """The same at three thresholds, in one pass."""
    return evaluation.swept(_judged(spark, sf_dir), F.col("truth"), F.col("score"), "lang")


def class_counter(spark, sf_dir):
    """Labels counted by language and value, one column a value."""
    return _judged(spark, sf_dir).groupBy("lang").pivot("quality", [0, 1]).agg(F.count("doc_id")).na.fill(0, ["0", "1"]).withColumnsRenamed({"0": "low", "1": "high"})


def candidate_gates(spark, sf_dir):
    """Labels on which the candidate's largest masks outgrow production's."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 3).alias("label"), (F.col("l_quantity") / 6400).alias("f"), "l_returnflag")
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).groupBy("image", "label").agg(F.max("f").alias("largest_fraction"), F.count("*").alias("mask_count"))
    return evaluation.gates(evaluation.compared(side("R"), side("A"))).withColumn("worst", F.round("worst", 9))


def regression_gates(spark, sf_dir):
    """Checks of each order as a site against a baseline made from its key."""
    site = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.sum(F.col("l_partkey") % 7).cast("double").alias("o"), F.count("*").alias("n"))
    c = evaluation.regression_checks(F.col("a"), 100.0 + F.col("l_orderkey") % 3, F.col("o"), F.lit(40.0), F.col("n"), F.lit(8))
    return site.withColumn("c", c).select("l_orderkey", "c.*")


QUERIES = {f.__name__: f for f in (swiss_rid_overlap, largest_rid_fraction, source_fallback, source_union, survey_clip, detection_parts, alias_normalise, provenance_merge_keyed, merge_order, kind_source_summary, overlap_pairs, trusted_pv_arbitration_boxes, box_union_area, greedy_merge, image_class_summary, clipped_to_roof, chip_roof_overlap, hash_split, exact_dedup_first_wins, boundary_exclusion, chained_exclusion, priority_overlap_exclusion, label_remap_dedup, seeded_sample, confusion_metrics, threshold_sweep, class_counter, candidate_gates, regression_gates)}

_RAW = f"""raw AS ({fixture_sql("raw_detections")}),
named AS (SELECT *, coalesce(MAP {{'existing_pv': 'pv_installation', 'solar_panel': 'pv_installation', 'solar_panels': 'pv_installation', 'pv': 'pv_installation', 'unknown_obstacle': 'other_obstacle', 'window': 'skylight'}}[name], name) AS full_name FROM raw),
ok AS (SELECT id, analysis, seq, x1, y1, x2, y2, confidence, full_name AS kind, full_name AS label, coalesce(source, 'unknown') AS source, coalesce(model, source, 'unknown') AS model FROM named
  WHERE full_name IN ('pv_installation', 'roof', 'chimney', 'skylight', 'dormer', 'other_obstacle', 'ladder', 'tree', 'shadow')
  AND (confidence IS NULL OR (NOT isnan(confidence) AND confidence BETWEEN 0 AND 1)) AND (x2 - x1) * (y2 - y1) > 1e-8)"""
_PRIORITY = "coalesce(MAP {'survey': 50, 'height': 40, 'rooflight': 30, 'swiss': 20, 'rid': 10}[source], 0)"
_OVER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"


def union_sql(source: str, key: str, name: str = "") -> str:
    """SQL of the area that boxes cover together, by slabs between neighbouring x edges."""
    return f"""{name}edges AS (SELECT DISTINCT {key}, unnest([x1, x2]) AS e FROM {source}),
{name}slabs AS (SELECT {key}, e, lead(e) OVER (PARTITION BY {key} ORDER BY e) AS f FROM {name}edges),
{name}inside AS (SELECT s.{key}, s.e, s.f, b.y1, b.y2, max(b.y2) OVER (PARTITION BY s.{key}, s.e ORDER BY b.y1, b.y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM {name}slabs s JOIN {source} b ON s.{key} = b.{key} AND b.x1 <= s.e AND b.x2 >= s.f WHERE s.f IS NOT NULL),
{name}covered AS (SELECT {key}, sum(greatest(0, y2 - greatest(y1, coalesce(seen, y1))) * (f - e)) AS union_area FROM {name}inside GROUP BY {key})"""


_MEET = "a.x1 - 2 < b.x2 AND b.x1 < a.x2 + 2 AND a.y1 - 2 < b.y2 AND b.y1 < a.y2 + 2"
_MASKS = f"""m AS (SELECT *, analysis::VARCHAR || kind AS k, {SOURCES_SQL} AS s FROM ({fixture_sql("order_boxes")})), {union_sql("m", "k")},
each_ AS (SELECT analysis AS image, kind AS label, count(*) AS mask_count, max((x2 - x1) * (y2 - y1)) AS largest_area, max(confidence) AS max_confidence FROM m GROUP BY ALL),
named AS (SELECT image, label, string_agg(DISTINCT x, ',' ORDER BY x) AS sources FROM (SELECT analysis AS image, kind AS label, unnest(s) AS x FROM m) GROUP BY ALL)"""


def _near(reach: float) -> str:
    return f"abs(t.x - h.x) <= {reach} AND abs(t.y - h.y) <= {reach}"


def _chained(reach: float) -> str:
    return f"""WITH chips AS ({fixture_sql("chips")}),
val AS (SELECT * FROM chips t WHERE split = 'val' AND NOT EXISTS (SELECT 1 FROM chips h WHERE h.split = 'test' AND {_near(reach)})),
held AS (SELECT * FROM chips WHERE split = 'test' UNION ALL SELECT * FROM val),
kept AS (SELECT * FROM held UNION ALL SELECT * FROM chips t WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM held h WHERE {_near(reach)}))"""


_SPLIT = "CASE WHEN ('0x' || substr(sha256('42:' || k), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(sha256('42:' || k), 1, 8))::BIGINT % 100 < 85 THEN 'val' ELSE 'test' END"
_JUDGED = "judged AS (SELECT l.doc_id, lang, least(n_chars, 4096) / 4096.0::DOUBLE AS score, quality = 1 AS truth, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
_SCORES = "CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END AS iou, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS dice, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall"
_COUNTS = "count(*) FILTER (truth AND score >= t) AS tp, count(*) FILTER (NOT truth AND score >= t) AS fp, count(*) FILTER (truth AND score < t) AS fn"

SQL = {
    "alias_normalise": f"WITH {_RAW} SELECT id, kind, label, confidence, source, model FROM ok",
    "provenance_merge_keyed": f"""WITH {_RAW}, ranked AS (SELECT *, row_number() OVER (PARTITION BY analysis, kind ORDER BY {_PRIORITY} DESC, coalesce(confidence, 0) DESC, seq) AS n FROM ok)
SELECT analysis, kind, max(source) FILTER (n = 1) AS source, max(confidence) AS confidence, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS members FROM ranked GROUP BY analysis, kind""",
    "merge_order": f"WITH {_RAW} SELECT id, analysis, row_number() OVER (PARTITION BY analysis ORDER BY coalesce(confidence, 0) DESC, seq)::INTEGER AS place FROM ok",
    "kind_source_summary": f"WITH {_RAW} SELECT kind || ':' || source AS kind_source, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS area FROM ok GROUP BY 1",
    "overlap_pairs": f"""WITH b AS ({fixture_sql("boxes")}), pairs AS (SELECT a.id AS a_id, b.id AS b_id, {_OVER} AS overlap, (a.x2 - a.x1) * (a.y2 - a.y1) AS p, (b.x2 - b.x1) * (b.y2 - b.y1) AS q
  FROM b a JOIN b ON a.kind = b.kind AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) SELECT a_id, b_id, overlap FROM pairs WHERE overlap > 0.5 * least(p, q)""",
    "trusted_pv_arbitration_boxes": f"""WITH d AS (SELECT *, {SOURCES_SQL} AS s FROM ({fixture_sql("boxes")})),
met AS (SELECT a.id, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2 FROM d a JOIN d b
  ON a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE a.kind NOT IN ('pv_installation', 'roof', 'shadow') AND a.s = ['rid'] AND b.kind = 'pv_installation' AND list_contains(b.s, 'swiss') AND b.confidence >= 0.5),
{union_sql("met", "id")}
SELECT d.id, kind, array_to_string(s, ',') AS sources, (x2 - x1) * (y2 - y1) - coalesce(union_area, 0) AS clipped_area, kind <> 'shadow' AS blocks_placement FROM d LEFT JOIN covered c ON d.id = c.id WHERE (x2 - x1) * (y2 - y1) - coalesce(union_area, 0) > 1e-8""",
    "box_union_area": f"WITH b AS ({fixture_sql('order_boxes')}), {union_sql('b', 'analysis')} SELECT * FROM covered",
    "image_class_summary": f"""WITH {_MASKS} SELECT e.*, union_area AS total_area, union_area / 64 AS total_fraction, largest_area / 64 AS largest_fraction, sources FROM each_ e JOIN covered c ON c.k = e.image::VARCHAR || e.label JOIN named n ON n.image = e.image AND n.label = e.label""",
    "swiss_rid_overlap": f"""WITH d AS (SELECT *, {SOURCES_SQL} AS s FROM ({fixture_sql("order_boxes")})), pv AS (SELECT * FROM d WHERE kind = 'pv_installation' AND list_contains(s, 'swiss')), hard AS (SELECT * FROM d WHERE kind = 'chimney' AND list_contains(s, 'rid')),
met AS (SELECT a.analysis, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2 FROM pv a JOIN hard b ON a.analysis = b.analysis AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
{union_sql("met", "analysis")}, {union_sql("pv", "analysis", "pv_")}
SELECT i.analysis AS image, round(coalesce(c.union_area, 0), 6) AS overlap, round(coalesce(c.union_area, 0) / 64, 6) AS fraction, round(CASE WHEN p.union_area > 0 THEN coalesce(c.union_area, 0) / p.union_area ELSE 0 END, 6) AS relative
FROM (SELECT DISTINCT analysis FROM d) i LEFT JOIN covered c USING (analysis) LEFT JOIN pv_covered p USING (analysis)""",
    "largest_rid_fraction": f"""WITH {_MASKS} SELECT e.image, coalesce(max(largest_area / 64) FILTER (e.label <> 'pv_installation' AND contains(',' || sources || ',', ',rid,')), 0) AS largest FROM each_ e JOIN named n ON n.image = e.image AND n.label = e.label GROUP BY e.image""",
    "source_fallback": f"SELECT CASE WHEN id % 8 = 0 THEN 'rid,swiss' ELSE coalesce(source, model, 'unknown') END AS sources, count(*) AS n FROM ({fixture_sql('raw_detections')}) GROUP BY 1",
    "source_union": f"""SELECT source, count(*) AS n, count(*) FILTER (source <> 'height') AS kinds, count(*) FILTER (source = 'height') AS places, count(confidence) FILTER (source = 'rid') AS scores
FROM ({fixture_sql("boxes")}) WHERE source IN ('survey', 'height', 'rid') GROUP BY source""",
    "survey_clip": f"""WITH b AS (SELECT * FROM ({fixture_sql("boxes")}) WHERE source = 'survey'), a AS (SELECT id AS roof, x / 16 AS x1, y / 2 AS y1, x / 16 + 10 AS x2, y / 2 + 10 AS y2 FROM ({fixture_sql("chips")}))
SELECT a.roof, b.id, {_OVER} AS area FROM a JOIN b ON a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 WHERE {_OVER} >= 0.15::DOUBLE""",
    "detection_parts": f"SELECT id, part::INTEGER AS part, (x2 - x1) * (y2 - y1) / CASE part WHEN 0 THEN 1 ELSE 2 END AS area FROM ({fixture_sql('order_boxes')}), (SELECT unnest([0, 2]) AS part)",
    "clipped_to_roof": f"""SELECT id, (least(x2, 4.0) - greatest(x1, 1.0)) * (least(y2, 4.0) - greatest(y1, 1.0)) AS area, kind <> 'shadow' AS blocks FROM ({fixture_sql("order_boxes")})
WHERE least(x2, 4.0) > greatest(x1, 1.0) AND least(y2, 4.0) > greatest(y1, 1.0) AND (least(x2, 4.0) - greatest(x1, 1.0)) * (least(y2, 4.0) - greatest(y1, 1.0)) > 0.01""",
    "chip_roof_overlap": f"""WITH b AS ({fixture_sql("boxes")}), a AS (SELECT id, x AS x1, y AS y1, x + 100 AS x2, y + 100 AS y2 FROM ({fixture_sql("chips")})),
met AS (SELECT a.id AS chip, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2 FROM a JOIN b ON a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2), {union_sql("met", "chip")}
SELECT c.chip, n, union_area AS area FROM covered c JOIN (SELECT chip, count(*) AS n FROM met GROUP BY chip) m ON c.chip = m.chip WHERE union_area >= 100""",
    "hash_split": f"""WITH keys AS (SELECT 'documents' AS data, (doc_id // 4)::VARCHAR AS k FROM documents UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer)
SELECT data, {_SPLIT} AS split, count(*) AS n, min(k) AS first_key FROM keys GROUP BY ALL""",
    "exact_dedup_first_wins": """SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN min(doc_id) OVER (PARTITION BY text) END AS duplicate_of, doc_id = min(doc_id) OVER (PARTITION BY text) AS keep FROM documents""",
    "boundary_exclusion": f"""WITH chips AS ({fixture_sql("chips")}) SELECT id, split FROM chips WHERE split <> 'train' UNION ALL
SELECT id, split FROM chips t WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM chips h WHERE h.split <> 'train' AND {_near(100)})""",
    "chained_exclusion": f"{_chained(100)} SELECT id, split FROM kept",
    "priority_overlap_exclusion": f"""WITH f AS (SELECT id, split, x AS x1, y AS y1, x + 36 + id % 3 * 10 AS x2, y + 36 + id % 2 * 10 AS y2 FROM ({fixture_sql("chips")})),
test AS (SELECT * FROM f WHERE split = 'test'), val AS (SELECT * FROM f a WHERE split = 'val' AND NOT EXISTS (SELECT 1 FROM test b WHERE {_MEET})), held AS (SELECT * FROM test UNION ALL SELECT * FROM val)
SELECT id, split FROM held UNION ALL SELECT id, split FROM f a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM held b WHERE {_MEET})""",
    "label_remap_dedup": f"""WITH m AS (SELECT *, MAP {{0: 0, 1: 4, 2: 2, 3: 1, 4: 2, 5: 7, 6: 7, 7: 3, 8: 7, 9: 7, 10: 7}}[cls::INTEGER] AS mapped FROM ({fixture_sql("label_lines")})),
t AS (SELECT *, mapped::VARCHAR || ' ' || coords AS line FROM m WHERE mapped IS NOT NULL AND len(string_split(coords, ' ')) >= 6 AND NOT contains(coords, '2') AND NOT contains(coords, 'x'))
SELECT file, line_no, mapped, line FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY line_no) AS n FROM t) WHERE n = 1""",
    "seeded_sample": f"SELECT split, id FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('42:' || id::VARCHAR), id) AS n FROM ({fixture_sql('chips')})) WHERE n <= 8",
    "confusion_metrics": f"WITH {_JUDGED}, counts AS (SELECT lang, {_COUNTS} FROM judged, (SELECT 0.25 AS t) GROUP BY lang) SELECT *, {_SCORES} FROM counts",
    "threshold_sweep": f"WITH {_JUDGED}, counts AS (SELECT lang, t AS threshold, {_COUNTS} FROM judged, (SELECT unnest([0.15::DOUBLE, 0.25::DOUBLE, 0.35::DOUBLE]) AS t) GROUP BY ALL) SELECT *, {_SCORES} FROM counts",
    "class_counter": f"WITH {_JUDGED} SELECT lang, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high FROM judged GROUP BY lang",
    "candidate_gates": """WITH l AS (SELECT l_orderkey AS image, l_linenumber % 3 AS label, max(l_quantity / 6400) AS f, l_returnflag AS g FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL),
p AS (SELECT coalesce(c.label, p.label) AS label, coalesce(c.f, 0) AS c, coalesce(p.f, 0) AS p FROM (SELECT * FROM l WHERE g = 'R') c FULL JOIN (SELECT * FROM l WHERE g = 'A') p ON c.image = p.image AND c.label = p.label)
SELECT label, bool_and(NOT (c > 0.005 AND c > p + 0.0001::DOUBLE)) AS passed, count(*) FILTER (c > 0.005 AND c > p + 0.0001::DOUBLE) AS violations, round(max(c - p), 9) AS worst FROM p GROUP BY label""",
    "regression_gates": """WITH s AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_partkey % 7)::DOUBLE AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, abs(a - (100.0 + l_orderkey % 3)) <= 1 AS pv_area, o <= 0.35::DOUBLE * 40.0::DOUBLE AS overlap, abs(n - 8) <= 5 AS panels FROM s) SELECT *, pv_area AND overlap AND panels AS passed FROM c""",
}
