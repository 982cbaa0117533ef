"""Source divergence against sums over all terms, counts of zero included."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_llm import DOCS, corpus

from solarweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, ranks=200):
    """The rows of the audit of (text, lang, source)."""
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held, every, by = Counter(t for d in own for t in set(d[2])), Counter(t for d in own for t in d[2]), {}
        for _, source, terms in own:
            by.setdefault(source, Counter()).update(terms)
        kept = sorted(t for t in held if held[t] >= least)

        def share(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        q, p = share(every), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in by if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def sample(seed=5):
    rng = random.Random(seed)
    names = ["the", "The", "été", "ÉTÉ", "日本", "zero", "a", "b1c", "x_y", "don't", "naïve"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    rows = []
    for i in range(150):
        source = rng.choice(("s0", "s0", "s0", "s1", "s2", "é", None, "", "S1"))
        own = names[: 20 + 10 * (i % 7)]
        rows.append((rng.choice((" ", "\n", "-", "1 ")).join(rng.choices(own, k=rng.randint(0, 60))), rng.choice(("en", "en", "de", None)), source))
    rows += [(None, "en", "nothing"), ("", "de", "s0"), ("12 34 !?", "en", "digits"), ("only these words", "fr", "s0"), ("two documents only", "fr", "s9"), ("the " * 5000, "en", "s0")]
    return rows + [rows[0]] * 3


def test_equals_sums_over_all_terms(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(6)
    out = divergence.audited(df)
    assert out.columns == "lang source part item value rank".split() and [t for _, t in out.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute(rows)
    assert {(r[0], r[1]) for r in got} == {(a or "", b or "") for _, a, b in rows} and any(r[4] == 0 for r in got if r[0] == "fr")
    assert sorted(map(tuple, divergence.audited(df, 1, 7).collect())) == brute(rows, 1, 7)


def test_odd_and_empty_tables(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    assert sorted(map(tuple, divergence.audited(df).collect())) == brute([(r[1], r[2], r[3]) for r in corpus()])
    assert divergence.audited(df.filter("false")).count() == 0
    assert divergence.audited(spark.createDataFrame([(None, None, None)], "text string, lang string, source string")).count() == 0


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("aB 1é日_\n", weights=(9, 3, rng.choice((0, 1, 5)), 1, 2, 2, 1, 1), k=rng.randint(0, 120)))
        assert [t.decode() for part in divergence.terms_of(text.encode()) for t in part] == [w.translate(LOWER) for w in TERM.findall(text)]


def test_tasks_pass_on_what_they_counted(spark):
    rows = sample()
    counts = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))
    got = {tuple(r)[:3]: (r.n, r.docs) for r in counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    every, held = Counter(), Counter()
    for text, lang, source in rows:
        terms = [w.translate(LOWER) for w in TERM.findall(text or "")]
        every.update((lang or "", source or "", t) for t in terms)
        held.update((lang or "", source or "", t) for t in set(terms))
    assert got == {k: (every[k], held[k]) for k in every}


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (10**13, 10**14, 10**9), (3 * 10**12, 7 * 10**12 + 1, 12345), (5, 9, 3)]
    df = spark.createDataFrame(cases, "c long, n long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert {tuple(r) for r in df.collect()} == {(c, n, v, 1 + 10**9 * (c + 1) // (n + v)) for c, n, v in cases}
    assert spark.range(1).select(divergence.distance(F.lit(10**9 + 1), F.lit(1)).alias("d")).first().d == 10**18


def test_sources_that_meet_in_lists():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 6, 200)
    g = np.concatenate([rng.permutation(8)[:n] for n in lengths]) * 1000 + 7
    p, p0 = rng.integers(1, 10**9, len(g)), (g % 13 + 1) * 1000
    want, at = Counter(), 0
    f = lambda a, b: (a - b) ** 2 // b
    for n in lengths.tolist():
        own = [tuple(map(int, x)) for x in zip(g[at : at + n], p[at : at + n], p0[at : at + n], strict=True)]
        at += n
        for a, x, x0 in own:
            for b, y, y0 in own:
                if a != b:
                    want[a, b] += f(x, y) - f(x, y0) - f(x0, y) + f(x0, y0)
    assert {(int(a), int(b)): int(v) for a, b, v in zip(*divergence.met_pairs(g, p, p0, lengths), strict=True)} == dict(want)
    assert all(len(x) == 0 for x in divergence.met_pairs(g[:0], p[:0], p0[:0], lengths[:0]))
