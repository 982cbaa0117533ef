"""Substring dedup: content-defined chunks by a gear rolling hash, found again by digest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, octets
from solarweave.llm.gear import cuts
from solarweave.storage import Stored, joined_back, stored

#: Chunks of some 50 bytes on average, 128 at most; repeats shorter than LEAST_RUN bytes (some 50 short words) are left.
CHUNK_WIDTH, CHUNK_MOST, LEAST_RUN = 26, 128, 200
#: Bytes on either side of a run of chunks that are compared for its exact ends: a chunk, and what decides on a cut.
REACH = CHUNK_MOST + 2 * CHUNK_WIDTH


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, th, t): th tells apart texts of one id."""
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t"))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, start, stop, h1, h2) of every chunk of every whole text, in bytes of its UTF-8.

    th is a hash of the text, h1 and h2 are a 128-bit digest of the chunk. A digest that a text
    has several times comes once for each. Null and empty texts have no chunk; a null id stays null.
    """

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            texts, starts, stops, counts, digests = octets(batch.column("t")), [], [], [], []
            for t in texts:
                ends = cuts(t, CHUNK_WIDTH, CHUNK_MOST)
                begin = [0, *ends][: len(ends)]
                starts += begin
                stops += ends
                counts.append(len(ends))
                digests += [xxhash.xxh3_128_digest(t[a:b]) for a, b in zip(begin, ends, strict=True)]
            words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = pa.array(np.repeat(np.arange(len(texts)), counts))
            return {
                "doc_id": batch.column("doc_id").take(own), "th": batch.column("th").take(own), "start": pa.array(np.array(starts, np.int32)), "stop": pa.array(np.array(stops, np.int32)),
                "h1": pa.array(np.ascontiguousarray(words[:, 0])), "h2": pa.array(np.ascontiguousarray(words[:, 1])),
            }

        return each

    return by_batch(_rows(docs, key, text), "doc_id long, th long, start int, stop int, h1 long, h2 long", start)


def _document() -> Column:
    """What orders documents: by id, rows without one last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")


def _repeated(every: DataFrame, within: bool) -> DataFrame:
    """every's chunks whose digest comes in another document (or, within, anywhere else), with first: its first place, and many: whether it has more than two."""
    place = F.struct(_document().alias("doc"), "start")
    shared = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place if within else F.struct(_document().alias("doc"))).alias("last"), (F.count("*") > 2).alias("many"))
    shared = shared.filter("first != last" if within else "first.doc != last.doc").drop("last")
    return joined_back(every, shared, ["h1", "h2"])


def _later(repeated: DataFrame, within: bool) -> DataFrame:
    """The rows of _repeated that aren't the first of their digest."""
    return repeated.filter(F.struct(_document().alias("doc"), "start") != F.col("first") if within else _document() != F.col("first.doc")).distinct()


def _runs(repeated: DataFrame, within: bool, least: int) -> DataFrame:
    """Adjacent chunks that came before: (doc_id, th, start, stop, n_chunks, first_doc_ids, head, tail, digests).

    head and tail (doc_id, th, at) are where the first chunk of the run begins, and where its
    last one ends, in the documents that hold them first. digests are those of the chunks with
    more than two places of a run of under least bytes, else null.
    """
    own = Window.partitionBy("doc_id", "th").orderBy("start")
    opens = F.when(F.lag("stop").over(own) == F.col("start"), 0).otherwise(1)
    runs = _later(repeated, within).withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda n: F.struct("first.doc.doc_id", "first.doc.th", (F.col("first.start") + n).alias("at"))
    runs = runs.groupBy("doc_id", "th", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("first.doc.doc_id")).alias("first_doc_ids"),
        F.min_by(at(F.lit(0)), "start").alias("head"), F.max_by(at(F.col("stop") - F.col("start")), "start").alias("tail"), F.collect_list(F.when(F.col("many"), F.struct("h1", "h2"))).alias("digests"),
    )
    return runs.drop("run").withColumn("digests", F.when(F.col("stop") - F.col("start") < least, F.col("digests")))


def _at(docs: DataFrame, asked: DataFrame, key: str, text: str, schema: str, each: Callable[[bytes, dict], Iterator[tuple]]) -> DataFrame:
    """(doc_id, th, schema): what each makes of a whole text and of every row that is asked of it (doc_id, th, others)."""
    asks = [c for c in asked.columns if c not in ("doc_id", "th")]
    grouped = asked.distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct(*asks)).alias("asks"))
    grouped = stored(grouped.select(F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), "asks"), "asks")
    rows = _rows(docs, key, text)
    rows = rows.join(grouped, (rows.th == grouped.a_th) & rows.doc_id.eqNullSafe(grouped.a_id)).select("doc_id", "th", "t", "asks")
    names = [f.split()[0] for f in schema.split(", ")]

    def start():
        def run(batch: pa.RecordBatch) -> dict:
            own, out = [], []
            for i, (t, asks) in enumerate(zip(octets(batch.column("t")), batch.column("asks").to_pylist(), strict=True)):
                for ask in asks:
                    for found in each(t, ask):
                        own.append(i)
                        out.append(found)
            own, columns = pa.array(own, pa.int64()), zip(*out, strict=True) if out else ([] for _ in names)
            return {"doc_id": batch.column("doc_id").take(own), "th": batch.column("th").take(own)} | dict(zip(names, map(list, columns), strict=True))

        return run

    return by_batch(rows, f"doc_id long, th long, {schema}", start)


def _agreed(docs: DataFrame, ends: DataFrame, before: int, after: int, key: str, text: str) -> DataFrame:
    """ends with more: the bytes that doc_id, th has before at (left; before at most) or from there on (after at most) just as other has (doc_id, th, at)."""

    def near(t: bytes, ask: dict) -> Iterator[tuple]:
        yield ask["at"], ask["left"], t[max(0, ask["at"] - before) : ask["at"]] if ask["left"] else t[ask["at"] : ask["at"] + after]

    asked = ends.select("doc_id", "th", "at", "left").union(ends.select("other.doc_id", "other.th", "other.at", "left"))
    contexts = _at(docs, asked, key, text, "at int, left boolean, near binary", near)
    contexts = stored(contexts.groupBy("doc_id", "th", "at", "left").agg(F.min("near").alias("near")), "contexts")
    side = lambda p: contexts.select(*(F.col(c).alias(f"{p}_{c}") for c in contexts.columns))
    met = lambda p, own: [F.col(f"{own}th") == F.col(f"{p}_th"), F.col(f"{own}at") == F.col(f"{p}_at"), F.col("left") == F.col(f"{p}_left"), F.col(f"{own}doc_id").eqNullSafe(F.col(f"{p}_doc_id"))]
    both = ends.join(side("own"), met("own", "")).join(side("first"), met("first", "other."))
    own = [c for c in ends.columns if c not in ("at", "other")]

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            sides = zip(*(batch.column(c).to_pylist() for c in ("own_near", "first_near", "left")), strict=True)
            return {c: batch.column(c) for c in own} | {"more": [common(*s) for s in sides]}

        return each

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ends.select(*own).schema)
    return by_batch(both.select(*own, "own_near", "first_near"), f"{schema}, more int", start)


def common(a: bytes, b: bytes, left: bool) -> int:
    """Bytes that two texts share at their ends (left) or beginnings."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(s[len(s) - n :] if left else s[:n], np.uint8) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return n if not len(differ) else int(n - 1 - differ[-1] if left else differ[0])


def _missed(docs: DataFrame, repeated: DataFrame, short: DataFrame, known: DataFrame, within: bool, key: str, text: str, least: int) -> DataFrame:
    """(doc_id, th, start, stop, first_doc_ids): passages around short runs that some earlier document holds whole, though not the first to hold their chunks.

    All places of those chunks of short runs that have more than two are looked at: windows of
    nearly least bytes begin at each and at some steps before, so a passage of least bytes around
    a chunk has one of them whole. The first place of each window is found by its hash, and the
    passage by comparison with that place, once for windows that overlap and agree with one text
    at one distance. Windows inside what is known already (k_id, k_th, k_start, k_stop) aren't followed.
    """
    step = max(1, least // 16)
    width = least - step
    asked = stored(short.select(F.inline("digests")).distinct(), "digests")
    places = repeated.join(asked, ["h1", "h2"]).select("doc_id", "th", F.col("start").alias("at"))

    def windows(t: bytes, ask: dict) -> Iterator[tuple]:
        for w in range(ask["at"], max(-1, ask["at"] - least), -step):
            if w + width <= len(t):
                yield w, xxhash.xxh3_64_intdigest(t[w : w + width]) - (1 << 63)

    found = stored(_at(docs, places, key, text, "w int, hash long", windows), "windows")
    place = F.struct(_document().alias("doc"), "w")
    held = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place if within else F.struct(_document().alias("doc"))).alias("last")).filter("first != last" if within else "first.doc != last.doc").drop("last")
    own = stored(short.select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th")).distinct(), "short")
    hits = joined_back(found, held, "hash").filter(place != F.col("first") if within else _document() != F.col("first.doc")).drop("hash").distinct()
    hits = hits.join(own, (F.col("th") == F.col("s_th")) & F.col("doc_id").eqNullSafe(F.col("s_id")), "left_semi")
    hits = hits.join(known, (F.col("th") == F.col("k_th")) & F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("k_start") <= F.col("w")) & (F.col("w") + width <= F.col("k_stop")), "left_anti")
    line = Window.partitionBy("doc_id", "th", "first.doc", F.col("w") - F.col("first.w")).orderBy("w")
    hits = hits.withColumn("last", F.lag("w").over(line)).filter(F.col("last").isNull() | (F.col("w") - F.col("last") > width))
    other = F.struct("first.doc.doc_id", "first.doc.th", F.col("first.w").alias("at"))
    ends = stored(hits.select("doc_id", "th", F.col("w").alias("begin"), F.col("w").alias("at"), other.alias("other")).select("*", F.col("other.doc_id").alias("holder"), F.explode(F.array(F.lit(True), F.lit(False))).alias("left")), "window_ends")
    more = F.col("more")
    whole = _agreed(docs, ends, REACH, 2 * width + REACH, key, text).groupBy("doc_id", "th", "begin", "holder").agg(F.max(F.when(F.col("left"), more)).alias("before"), F.max(F.when(~F.col("left"), more)).alias("after"))
    whole = whole.filter(F.col("after") >= width).select("doc_id", "th", (F.col("begin") - F.col("before")).alias("start"), (F.col("begin") + F.col("after")).alias("stop"), "holder")
    whole = whole.filter(F.col("stop") - F.col("start") >= least).groupBy("doc_id", "th", "start", "stop")
    return whole.agg(F.array_sort(F.collect_set("holder")).alias("first_doc_ids"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_RUN, within: bool = True) -> DataFrame:
    """Passages of at least bytes that came before: in a smaller id, or earlier in the same text.

    Columns: doc_id, th (hash of the text, which tells apart rows of one id), start, stop
    (bytes of the UTF-8), n_chunks, first_doc_ids (ids that hold the chunks first, ascending).
    The first copy, by id (null last), text and place, stays and has no row. Adjacent
    repeated chunks are one run; a run is then extended on both sides byte by byte as far as
    it agrees with its first copy, at most REACH bytes, which is more than the chunks that an
    end of the passage cuts through. Runs may overlap after that. Rows of one id and text count
    as one document. Without within, what only one text repeats in itself is left.

    A run that stays under least bytes then may be the inside of a passage whose chunks a third
    document holds still earlier, with other text around. Its chunks are looked up once more, by
    windows of nearly least bytes (_missed); what is found so has n_chunks 0 and the document
    that holds the window first. Null and empty texts have no passage; ties of place don't occur,
    as rows equal in id and text are one. Very long texts are cut and compared whole, each in one task.

    A passage that holds no whole chunk is not seen: chunks have 128 bytes at most and lie at
    the same places in equal text, so that of least bytes holds one but for rare cases at
    forced cuts. Texts are cut once. Digests are counted with map-side combining, and what
    is joined back has each digest or place once, so common passages are no hot spot.
    """
    every = Stored(chunks(docs, key, text), "chunks")
    repeated = stored(_repeated(every.df, within), "repeated")
    every.drop()
    runs = stored(_runs(repeated, within, least), "runs")
    own = ("doc_id", "th", "start", "stop", "n_chunks", "first_doc_ids")
    ends = runs.select(*own, F.inline(F.array(
        F.struct(F.lit(True).alias("left"), F.col("start").alias("at"), F.col("head").alias("other")),
        F.struct(F.lit(False).alias("left"), F.col("stop").alias("at"), F.col("tail").alias("other")),
    )))
    more = _agreed(docs, ends, REACH, REACH, key, text).groupBy("doc_id", "th", "start", "stop").agg(F.max("n_chunks").alias("n_chunks"), F.max("first_doc_ids").alias("first_doc_ids"), F.max(F.when(F.col("left"), F.col("more"))).alias("before"), F.max(F.when(~F.col("left"), F.col("more"))).alias("after"))
    whole = stored(more.withColumns({"from": F.col("start") - F.col("before"), "to": F.col("stop") + F.col("after")}), "whole")
    long = F.col("to") - F.col("from") >= least
    out = whole.filter(long).select("doc_id", "th", F.col("from").alias("start"), F.col("to").alias("stop"), "n_chunks", "first_doc_ids")
    runs = runs.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), F.col("start").alias("r_start"), "digests").filter("size(digests) > 0")
    short = whole.filter(~long).join(runs, (F.col("th") == F.col("r_th")) & (F.col("start") == F.col("r_start")) & F.col("doc_id").eqNullSafe(F.col("r_id"))).select("doc_id", "th", "digests")
    known = out.select(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th"), F.col("start").alias("k_start"), F.col("stop").alias("k_stop"))
    missed = _missed(docs, repeated, stored(short, "short_runs"), known, within, key, text, least)
    return out.unionByName(missed.select("doc_id", "th", "start", "stop", F.lit(0).cast("long").alias("n_chunks"), "first_doc_ids"))


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_RUN, within: bool = True) -> DataFrame:
    """docs with the bytes of all repeats taken out of text; all columns, one row for each row.

    Each text loses its own repeats, also where several rows have one id or none. A cut that
    falls inside a character takes the whole character. Null texts stay null.
    """
    cut = repeats(docs, key, text, least, within).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    kind = docs.schema[text].dataType.simpleString()

    @F.udf(kind, useArrow=True)
    def drop(value, spans):
        if value is None or not spans:
            return value
        data, at, out = value.encode(), 0, []
        for s in spans:
            out.append(data[at : s["start"]])
            at = max(at, s["stop"])
        return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{key}`").cast("long").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__th"))
    cut = stored(cut, "cut")
    joined = packed.join(cut, (F.col("__th") == F.col("th")) & F.col("__id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(*(drop(F.col(f"__row.{c}"), F.col("cut")).alias(c) if c == text else F.col(f"__row.{c}") for c in docs.columns))
