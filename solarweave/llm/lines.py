"""Line dedup: two Bloom filters find the lines that may be repeated, and only these are dealt out and counted exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from solarweave.llm.batches import by_batch, give_back, in_batches, octets, pieces
from solarweave.storage import joined_back, stored

#: What a key loses at both ends.
SPACE = " \t\n\x0b\x0c\r"
#: Fixed values of the query: lines this long, in so many documents, are repeats.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a filter for each line of the corpus, and the most that a filter has: 2**31 bits are 256 MB in each worker.
BITS_EACH, BITS_MOST = 16, 1 << 31
#: Words of 64 bits in a segment, the part of a filter that one row holds.
SEGMENT = 1 << 14
#: Hashes that a task gathers before it writes their bits.
GATHER = 1 << 22


def long_keys(texts: pa.Array, least: int = LEAST_CHARS) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of least code points or more, with the row and the line that each stands in; and the lines of each row.

    A key is a line without SPACE at its ends and with A-Z lower-cased. A null text is empty, and
    an empty text is one empty line.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), pattern="\n")
    flat, row = lines.flatten(), np.asarray(pc.list_parent_indices(lines), np.int64)
    counts = np.asarray(pc.list_value_length(lines), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = pc.ascii_lower(pc.utf8_trim(flat, characters=SPACE))
    at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), least)))
    return octets(keys.take(pa.array(at))), row[at], place[at], counts


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def bits(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, the word of the filter (from its high bits) and four bits of that word (from its low ones)."""
    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << (h >> np.uint64(shift) & np.uint64(63))
    return (h >> np.uint64(64 - (words.bit_length() - 1))).astype(np.int64), mask


def met(seen_twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash."""
    word, mask = bits(h, len(seen_twice))
    return seen_twice[word] & mask == mask


def _packed(words: np.ndarray) -> bytes:
    return pa.compress(words.tobytes(), codec="zstd", asbytes=True)


def _words(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=8 * SEGMENT, codec="zstd", asbytes=True), np.uint64)


def pieces_of(h: np.ndarray, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Segments of the filters of some hashes: (segment, bits of all, bits of those that come twice)."""
    h = np.sort(h)
    word, mask = bits(h, words)
    again = np.concatenate((h[1:] == h[:-1], [False]))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    at, once = word[first], np.bitwise_or.reduceat(mask, first)
    twice = np.bitwise_or.reduceat(np.where(again, mask, np.uint64(0)), first)
    for s, a in zip(*np.unique(at // SEGMENT, return_index=True), strict=True):
        b = np.searchsorted(at, (s + 1) * SEGMENT)
        dense = np.zeros((2, SEGMENT), np.uint64)
        dense[:, at[a:b] % SEGMENT] = once[a:b], twice[a:b]
        yield int(s), dense[0], dense[1]


def fold(pair: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Add a piece to a segment's two filters: what both have once is in the second."""
    pair[1] |= twice | pair[0] & once
    pair[0] |= once


def seen_twice(keys: DataFrame) -> np.ndarray:
    """The filter of hashes (column h) that come twice or more, as words; it may hold others, but misses none.

    Each task makes the bits of its hashes, segment by segment; a segment's pieces are folded
    where they meet. Only bits travel, a few bytes for each line, and one filter reaches the
    driver and the workers: BITS_EACH to twice as many bits for each line, and BITS_MOST at most, whatever
    the corpus. Beyond that the filter takes more lines for repeats that are none, and the exact
    count that follows has more to do; results are the same.
    """
    n = keys.count()
    words = max(SEGMENT, 1 << min(BITS_MOST.bit_length() - 1, max(1, BITS_EACH * n - 1).bit_length()) >> 6)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for s, once, twice in pieces_of(np.concatenate(held), words) if size else ():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [_packed(once)], "twice": [_packed(twice)]})

        for batch in batches:
            held.append(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= GATHER:
                yield from out()
                held, size = [], 0
        yield from out()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, once, twice in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                fold(segments.setdefault(s, np.zeros((2, SEGMENT), np.uint64)), _words(once), _words(twice))
        for s, pair in segments.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "twice": [_packed(pair[1])]})
        segments.clear()
        give_back()

    parts = keys.mapInArrow(split, "segment int, once binary, twice binary").repartition("segment")
    out = np.zeros(words, np.uint64)
    for r in in_batches(parts, merge, "segment int, twice binary").collect():
        out[r.segment * SEGMENT : (r.segment + 1) * SEGMENT] = _words(bytes(r.twice))
    return out


def _document_keys(docs: DataFrame, text: str, least: int) -> DataFrame:
    """(h) of every long key, once for each row of docs."""

    def start() -> Callable[[pa.RecordBatch], dict]:
        def each(batch: pa.RecordBatch) -> dict:
            keys, row, _, _ = long_keys(batch.column("t"), least)
            h = hashes(keys)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            return {"h": pa.array(h[np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])))].view(np.int64))}

        return each

    return by_batch(docs.select(F.col(f"`{text}`").alias("t")), "h long", start)


def _suspects(docs: DataFrame, twice, key: str, text: str, least: int) -> DataFrame:
    """(doc_id, th, line, digest) of the lines that the filter takes for repeated; th tells apart texts of one id."""

    def start() -> Callable[[pa.RecordBatch], dict]:
        words = twice.value

        def each(batch: pa.RecordBatch) -> dict:
            keys, row, line, _ = long_keys(batch.column("t"), least)
            at = np.flatnonzero(met(words, hashes(keys)))
            own = pa.array(row[at])
            return {"doc_id": batch.column("doc_id").take(own), "th": batch.column("th").take(own), "line": pa.array(line[at].astype(np.int32)), "digest": [hashlib.sha256(keys[i]).digest() for i in at]}

        return each

    t = F.col(f"`{text}`")
    return by_batch(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t")), "doc_id long, th long, line int, digest binary", start)


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with repeated lines taken out of text: all columns, and __lines (before) and __dropped as long.

    A line's key is the line without white space at its ends and with A-Z lower-cased. A key of
    least_chars code points or more that least_docs documents or more hold goes from all but
    the largest id that holds it, where every line of it stays. Other lines stay as they are,
    joined by \\n; a text that loses all its lines is empty, and a null text without loss stays null.

    Rows of one id are one document; all rows without id are one document together, before all
    others. Repeated rows lose the same lines. Null and empty texts are one empty line. An empty
    table gives no row. Columns of docs may have any names but __lines and __dropped.

    Lines are first looked up in a filter of those seen twice (seen_twice). The lines found there
    are all that is dealt out: 32 bytes and a place each, counted with map-side combining, so a
    line that all documents hold is no hot spot. Documents without such a line are never moved;
    the others meet their dropped lines once. A text is held whole by one task only.
    """
    spark = docs.sparkSession
    filter_words = spark.sparkContext.broadcast(seen_twice(stored(_document_keys(docs, text, least_chars), "line_keys")))
    suspects = stored(_suspects(docs, filter_words, key, text, least_chars), "suspects")
    repeated = suspects.groupBy("digest").agg((F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("docs"), F.max("doc_id").alias("holder")).filter(F.col("docs") >= least_docs)
    gone = joined_back(suspects, repeated.select("digest", "holder"), "digest").filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = stored(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("gone")), "gone_lines")

    @F.arrow_udf(BooleanType())
    def suspected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts), bool)
            at = 0
            for piece in pieces(pa.RecordBatch.from_arrays([texts], ["t"])):
                keys, row, _, _ = long_keys(piece.column("t"), least_chars)
                out[at + row[met(filter_words.value, hashes(keys))]] = True
                at += piece.num_rows
            yield pa.array(out)
        give_back()

    # numbered names can't clash, and a column that nobody asks for isn't moved
    own = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    value = F.col(own[text])
    packed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    asked = suspected(value)
    here = packed.filter(~asked).withColumns({"__kept": value, "gone": F.lit(None).cast("array<int>")})
    away = packed.filter(asked).withColumns({"__th": F.xxhash64(value), "__id": F.col(own[key]).cast("long")})
    away = away.join(gone, (F.col("__th") == F.col("th")) & F.col("__id").eqNullSafe(F.col("doc_id")), "left")
    left = F.transform(F.array(F.split(value, "\n")), lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: F.get(parts, i)))
    away = away.withColumn("__kept", F.when(F.col("gone").isNull(), value).otherwise(F.array_join(left[0], "\n")))
    both = here.unionByName(away.select(*here.columns))
    n = F.coalesce(F.length(value) - F.length(F.replace(value, F.lit("\n"))), F.lit(0)).cast("long") + 1
    return both.select(*(F.col("__kept" if c == text else own[c]).alias(c) for c in docs.columns), n.alias("__lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("__dropped"))
