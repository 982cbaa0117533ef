"""Source divergence audit: how far the words of a source lie from each other source of its language, by an inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, give_back, in_batches, octets, pieces
from solarweave.storage import stored

#: Bytes that belong to terms (letters, lower-cased, and all of other characters); others part them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed values of the query: documents that a term needs in its language, the scale of p, ranked terms of a source.
LEAST_DOCS, SCALE, RANKS = 3, 10**9, 200
#: Distinct terms that a task counts before it passes them on, and bytes of a text that are split at once.
GATHER, SLICE = 200_000, 1 << 20
#: Elements of one step of the pair sums.
STEP = 1 << 20


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, slice by slice; a slice ends where a term does."""
    at = 0
    while at < len(text):
        part = text[at : at + SLICE].translate(FOLD)
        if at + SLICE < len(text):
            cut = part.rfind(b" ")
            while cut < 0:  # one term longer than a slice
                more = text[at + len(part) : at + len(part) + SLICE].translate(FOLD)
                cut, part = (part + more).rfind(b" "), part + more
                if not more:
                    cut = len(part)
            part = part[:cut]
        yield part.split()
        at += len(part) + 1


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within a task; several tasks give the same term.

    Null lang, source and text are empty. A task holds GATHER terms and one slice of a text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, docs) in ((k, v) for k, v in held.items() if v[0]):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([a] * len(n)), "source": pa.array([b] * len(n)), "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64()), "docs": pa.array([docs[t] for t in n], pa.int64())})

        for batch in (p for b in batches for p in pieces(b)):
            for a, b, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), octets(batch.column("text")), strict=True):
                n, docs = held.setdefault((a, b), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(t):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                size += len(n) - before
                if size > GATHER:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()
        held.clear()
        give_back()

    own = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    return in_batches(own, run, "lang string, source string, term string, n long, docs long")


def div(a: Column, b: Column) -> Column:
    """a / b without the rest, exactly; for values that aren't negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact beyond 64 bits."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.when(total + terms > 0, 1 + div(F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms)))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); p and q are at most SCALE + 1, so the square fits 64 bits."""
    p, q = p.cast("long"), q.cast("long")
    return div((p - q) * (p - q), q)


def index(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, postings) of the terms in least documents of their language: each source that has the term, with its count.

    One shuffle by language and term serves both sums. A list has a source once at most.
    """
    dealt = counts.repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return whole.filter(F.col("docs") >= least).drop("docs")


def met_pairs(g: np.ndarray, p: np.ndarray, p0: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, value) summed over posting lists: what two sources of one list add to each other beyond what each adds alone.

    Lists lie one after the other, with their lengths. p is a source's share of the term, p0 its
    share of a term that it lacks. In a list, g beside h adds f(p, p') - f(p, p0') - f(p0, p') +
    f(p0, p0'), f the floored distance.
    """
    names, code = np.unique(g, return_inverse=True)
    first, sums = np.cumsum(lengths) - lengths, {}
    f = lambda a, b: (a - b) ** 2 // b
    for n in np.unique(lengths[lengths > 1]).tolist():
        rows = first[lengths == n]
        for some in np.array_split(rows, max(1, -(-len(rows) * n // STEP))):
            at = some[:, None] + np.arange(n)
            q, q0, h = p[at], p0[at], code[at]
            for i in range(n):
                a, a0 = q[:, i : i + 1], q0[:, i : i + 1]
                value = f(a, q) - f(a, q0) - f(a0, q) + f(a0, q0)
                key, place = np.unique(h[:, i : i + 1] * len(names) + h, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place.ravel(), value.ravel())
                for k, v in zip(key.tolist(), total.tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + v
    key, value = np.fromiter(sums, np.int64, len(sums)), np.fromiter(sums.values(), np.int64, len(sums))
    a, b = key // max(1, len(names)), key % max(1, len(names))
    other = a != b
    return names[a[other]], names[b[other]], value[other]


def _met(postings: DataFrame) -> DataFrame:
    """(g, h, value) of the sources that share terms, summed within batches."""
    lists = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("list")).select("list")

    def start() -> Callable[[pa.RecordBatch], dict]:
        def each(batch: pa.RecordBatch) -> dict:
            column = batch.column("list")
            flat = column.flatten()
            g, h, value = met_pairs(*(flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "p", "p0")), np.diff(column.offsets.to_numpy()))
            return {"g": pa.array(g), "h": pa.array(h), "value": pa.array(value)}

        return each

    return by_batch(lists.filter(F.size("list") > 1), "g long, h long, value long", start)


def audited(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against each other of its language, and its most distinctive terms.

    Terms are runs of letters and of characters beyond ASCII, only A-Z lower-cased. A language keeps
    the V terms of least documents (rows) or more. With p of a term in a source or language as
    share says, part pair has for each other source the sum of distance over all kept terms, and
    part term the kept terms that a source has and has more of than its language, by distance
    from it, the first ranks of them (ties: by the term's UTF-8). Values of a pair start at V times the
    distance of two terms that both lack. The posting of a source alone corrects it for all
    others by its count, so equal counts are corrected together; sources that meet in a list
    are corrected once more. No zero count is ever made a row.

    Null lang, source and text are empty; a source without terms has pairs, and 0 if its
    language keeps none. Repeated rows count each. An empty table gives no row. One source in
    most documents is no hot spot: its terms are counted in tasks before they meet. A posting list
    has the sources of one language, which the pairs of the result outnumber.
    """
    kept = stored(index(term_counts(docs), least), "index")
    flat = kept.select("lang", "term", "total", F.inline("postings"))
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all"))
    groups = own.join(flat.groupBy("lang", "source").agg(F.sum("n").alias("words")), ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("words", "terms", "all")))
    groups = stored(groups.withColumns({"g": F.monotonically_increasing_id(), "p0": share(F.lit(0), F.col("words"), F.col("terms"))}), "groups")
    postings = stored(flat.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("words"), F.col("terms"))), "postings")

    q = share(F.col("total"), F.col("all"), F.col("terms"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = postings.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= ranks)

    other = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p0").alias("r0"))
    alone = stored(postings.groupBy("lang", "g", "p", "p0").agg(F.count("*").alias("n")), "alone").join(other, "lang").filter("g != h")
    p, p0, r0 = F.col("p"), F.col("p0"), F.col("r0")
    to, back = F.col("n") * (distance(p, r0) - distance(p0, r0)), F.col("n") * (distance(r0, p) - distance(r0, p0))
    sums = alone.select(F.inline(F.array(F.struct("g", "h", to.alias("value")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), back.alias("value")))))
    sums = stored(sums.unionByName(_met(postings)).groupBy("g", "h").agg(F.sum("value").alias("more")), "corrections")
    pairs = groups.join(other, "lang").filter("g != h").join(sums, ["g", "h"], "left")
    base = F.coalesce(F.col("terms") * distance(p0, r0), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("more", F.lit(0))).alias("value")).withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(more)
