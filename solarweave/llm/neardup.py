"""MinHash near-dedup by an inverted join on signature coordinates, with exact confirmation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solarweave.llm.batches import by_batch, octets
from solarweave.operators.components import connected_components
from solarweave.storage import joined_back, stored

#: Words of a shingle; similarity in hundredths.
WORDS, SIMILARITY = 5, 75
#: Coordinates of a signature, and how many of two must agree for a pair to be confirmed. Two
#: sets of similarity 0.75 agree in fewer with a probability of 1.1e-7 (a binomial sum; of 0.8, 8e-10).
COORDINATES, MATCHES = 40, 15
#: Nodes outside their list's first component, and shingles, of one block of the last comparison.
BLOCK, BLOCK_SHINGLES = 512, 750_000

MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.Generator(np.random.PCG64(11))
SEEDS = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]
ODD = (_RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    A-Z are lower-cased; words are runs other than ASCII white space. Fewer words than a
    shingle has make one shingle; no words make none.
    """
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    if len(own) < words:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=1)], np.uint64)
    n = len(own) - words + 1
    total = h[:n].copy()
    for k in range(1, words):
        total *= MIX
        total ^= total >> np.uint64(29)
        total += h[k : k + n]
    total *= MIX
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least 32-bit value of each of COORDINATES hash functions over a set that isn't empty."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = None
    for at in range(0, len(x), 2048):
        y = (x[None, at : at + 2048] ^ SEEDS) * ODD
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        part = y.min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least.view(np.int32)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, node, sig): th is a hash of the text, node a 128-bit digest of the set in hex, null if it is empty."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            sizes, nodes, sigs = [], [], []
            for t in octets(batch.column("t")):
                s = shingles(t)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n_shingles": sizes, "node": nodes, "sig": sigs}

        return each

    t = F.col(f"`{text}`")
    return by_batch(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("t")), "doc_id long, th long, n_shingles long, node string, sig array<int>", start)


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingle hashes of one document of each wanted (node, doc_id)."""

    def start():
        def each(batch: pa.RecordBatch) -> dict:
            nodes, sets = [], []
            for node, t in zip(batch.column("node").to_pylist(), octets(batch.column("t")), strict=True):
                own = shingles(t)
                if xxhash.xxh3_128_hexdigest(own.tobytes()) == node:  # else another row of the same id
                    nodes.append(node)
                    sets.append(own.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return {"node": nodes, "s": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))}

        return each

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("t")).join(wanted, "doc_id").select("node", "t")
    return by_batch(rows, "node string, s array<long>", start).dropDuplicates(["node"])


def _agree(a: str, b: str):
    """Coordinates in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def _fits(a: str, b: str):
    """Sizes that the similarity allows."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILARITY


def _posts(classes: DataFrame) -> DataFrame:
    """(token, node): the prefix of every class's signature, tokens rare first.

    A token is a coordinate and its value. Tokens of one class alone can match nobody, and a
    class with fewer than MATCHES others is skipped. Two classes that agree in MATCHES tokens
    share one within all but MATCHES - 1 of either's tokens, in any one order; with rare
    tokens first, what very many documents share comes last and is seldom posted.
    """
    place = F.posexplode("sig").alias("k", "v")
    tokens = classes.select("node", place).select("node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    mine = joined_back(tokens, often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    mine = mine.filter(F.size("own") >= MATCHES)
    return mine.select("node", F.explode(F.transform(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1)), lambda x: x["token"])).alias("token"))


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose signatures and then whose full sets are similar enough."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(_fits("n_a", "n_b")).filter(_agree("sig_a", "sig_b") >= MATCHES).select("a", "b", "n_a", "n_b")
    both = likely.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    met = both.withColumn("met", F.size(F.array_intersect("s_a", "s_b")))
    return met.filter(F.col("met") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("met")) * SIMILARITY).select("a", "b")


def _stars(posts: DataFrame) -> DataFrame:
    """Pairs of each list's least node with every other: as many as posts at most."""
    least = posts.groupBy("token").agg(F.min("node").alias("a"))
    return joined_back(posts, least, "token").filter("node != a").select("a", F.col("node").alias("b")).distinct()


def _joining(nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], asked: np.ndarray) -> list[tuple[str, str]]:
    """Links that join components: each asked node against all, by an inverted index of the full sets.

    Counts of common shingles come from the postings of the node's shingles, so nodes that
    share nothing cost nothing. A link whose ends are joined already is left out: there are
    fewer links than nodes, whatever the size of a group.
    """
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    postings, ends = owner[order], np.concatenate(([0], np.cumsum(np.bincount(code))))
    first = np.concatenate(([0], np.cumsum(sizes)))
    _, label = np.unique(comps, return_inverse=True)
    out = []
    for i in np.flatnonzero(asked).tolist():
        own = code[first[i] : first[i + 1]]
        met = np.bincount(np.concatenate([postings[ends[c] : ends[c + 1]] for c in own.tolist()]), minlength=len(sets))
        near = np.flatnonzero((met * 100 >= (sizes[i] + sizes - met) * SIMILARITY) & (label != label[i]))
        if len(near):
            others, at = np.unique(label[near], return_index=True)
            out += [(nodes[i], nodes[j]) for j in near[at]]
            label[np.isin(label, others)] = label[i]
    return out


def _open_links(posts: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components whose nodes share a posting list.

    Of any two components in a list one isn't the list's least; its nodes are asked, against
    all nodes that share a list with them. Asked nodes are dealt into blocks by the least
    component of their longest list, so that those with the same partners meet them together,
    and the partners of a block again by hash, by the number of their shingles: each task's
    memory is bounded, and what is shuffled is nodes, never pairs.
    """
    here = posts.join(labels, "node", "left").select("token", "node", F.coalesce("component", "node").alias("comp"))
    lists = here.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low != high")
    here = stored(joined_back(here, lists.select("token", "low", "n"), "token"), "open")
    asked = here.filter("comp != low").groupBy("node").agg(F.max(F.struct("n", "low"))["low"].alias("home"))
    asked = stored(asked.join(sets.select("node", "size"), "node"), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    deal = asked.groupBy("home").agg(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES).alias("share"))
    salt = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil("share")).cast("long"))
    asked = joined_back(asked, deal, "home").select("node", F.pmod(F.xxhash64("home", salt), F.lit(blocks)).alias("block"))
    wanted = here.select("token", "node").join(asked, "node").select("block", "token").distinct()
    partners = here.select("token", "node").join(wanted, "token").select("block", "node").distinct()
    comps = here.select("node", "comp").distinct()
    partners = partners.join(sets.select("node", "size"), "node")
    parts = stored(partners.groupBy("block").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("parts")), "parts")
    left = asked.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(True).alias("asked"))
    right = partners.join(parts, "block").select("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", F.lit(False).alias("asked"))
    rows = left.union(right).groupBy("block", "part", "node").agg(F.max("asked").alias("asked")).join(comps, "node").join(sets.select("node", "s"), "node")

    def meet(pdf):
        import pandas as pd

        links = _joining(pdf.node.to_numpy(), pdf.comp.to_numpy(), [np.asarray(x, np.int64) for x in pdf.s], pdf.asked.to_numpy())
        return pd.DataFrame(links, columns=["a", "b"], dtype=object)

    return rows.select("block", "part", "node", "asked", "comp", "s").groupBy("block", "part").applyInPandas(meet, "a string, b string")


def _labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, th, n_shingles, label, component_id) of every row; rows of one component have one label, null without shingles."""
    sigs = stored(signatures(docs, key, text), "signatures")
    classes = stored(sigs.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")
    posts = stored(_posts(classes), "posts")
    posted = classes.join(posts.select("node").distinct(), "node").select("node", "doc_id")
    sets = stored(_sets(docs, key, text, posted).withColumn("size", F.size("s")), "sets")
    first = stored(_confirm(_stars(posts), classes, sets), "links")
    labels = stored(connected_components(first), "labels")
    second = _open_links(posts, labels, sets)
    labels = stored(connected_components(first.union(second)), "labels")
    named = classes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("label"))
    ids = joined_back(named, named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label").select("node", "label", "component_id")
    return joined_back(sigs.select("doc_id", "th", "n_shingles", "node"), ids, "node", "left").select("doc_id", "th", "n_shingles", F.coalesce("label", "node").alias("label"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their shingle sets have a similarity of 0.75 or more. Equal sets
    are one class and count once from here on, so copies make no pairs. Signature coordinates
    of classes are posted under coordinate and value (see _posts). A first round confirms each
    posting list's least class with its others and takes components; a second compares what
    is then still apart within lists, so no link between components is left out and groups
    of near copies don't make all their pairs. Links are confirmed on the full sets; a link is
    missed only if two signatures agree in fewer than MATCHES coordinates (see there).

    Null and empty texts have no shingles and stand alone. A row without doc_id is no one's
    smallest id; its component is that of its links, else null, and so may kept be. Repeated
    rows come out repeated, with one component. Counts and minima that are joined back are
    written first (see storage.joined_back), so tokens, classes and components that hold a
    large share of all rows are split over tasks.
    """
    out = _labelled(docs, key, text)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id, of rows with that id the one with the least hash of its text.

    A row goes only for a row of its own component: texts of one id that are in different
    components all stay. Rows without shingles stay, once for each id and text. Of rows equal
    in id and text one stays. Rows without id can't be named as kept or as copies, and all
    stay. All columns stay as they are.
    """
    found = _labelled(docs, key, text).filter("doc_id is not null")
    plain = [F.col(f"__row.`{f.name}`") for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]  # what can be hashed
    group = F.struct("label", F.when(F.col("label").isNull(), F.struct("doc_id", "th")).alias("own"))
    kept = found.groupBy(group.alias("group")).agg(F.min(F.struct("doc_id", "th")).alias("first")).select(F.col("first.doc_id").alias("__kept"), F.col("first.th").alias("__th"))
    packed = docs.select(F.col(f"`{key}`").cast("long").alias("__kept"), F.xxhash64(F.col(f"`{text}`")).alias("__th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    first = joined_back(packed, kept, ["__kept", "__th"]).groupBy("__kept", "__th").agg(F.min_by("__row", F.xxhash64(*plain)).alias("__row"))
    return first.select("__row.*").union(packed.filter(F.col("__kept").isNull()).select("__row.*"))
