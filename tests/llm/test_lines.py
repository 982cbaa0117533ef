"""Line dedup against brute force on small inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, corpus, prose

from solarweave.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(doc_id, n_lines, n_dropped, text) of each (doc_id, text)."""
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(x.strip(SPACE).translate(LOWER), set()).add(i)
    out = []
    for i, t in rows:
        own, kept = (t or "").split("\n"), []
        for x in own:
            k = x.strip(SPACE).translate(LOWER)
            ids = held[k]
            if len(k) < 40 or len(ids) < 5 or i == max((j for j in ids if j is not None), default=None):
                kept.append(x)
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def shared_lines(seed=4):
    rng = random.Random(seed)
    common = [prose(rng, n) for n in (5, 6, 7, 8, 9, 40, 900)] + ["é" * 40, "É" * 40, "x" * 39, "ab " * 13 + "c"]
    rows = []
    for i in range(60):
        own = [prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 6))]
        for c in common:
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                own.insert(rng.randint(0, len(own)), rng.choice(("", " \t", "\x0b")) + rng.choice((c, c.upper() if c.isascii() else c)) + rng.choice(("", "\r", "  ")))
        rows.append((i, "\n".join(own)))
    same = common[0] + " held by few"
    rows += [(100 + i, same) for i in range(4)] + [(None, same), (None, same), (100, same)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join([common[5]] * 3000)), rows[3], rows[3], (3, "another text of this id\n" + common[5]), (None, common[5])]
    return rows + [(300 + i, "a line in four documents and no more, however often it stands") for i in range(4)] * 2


def test_equal_to_brute_force(spark):
    rows = shared_lines()
    df = spark.createDataFrame([(*r, "k", 1, b"r") for r in rows], "doc_id long, text string, th string, line int, gone binary").repartition(7)
    out = lines.deduped(df).collect()
    assert sorted(map(str, ((r.doc_id, r["__lines"], r["__dropped"], r.text or "") for r in out))) == sorted(map(str, brute(rows)))
    assert all((r.th, r.line, bytes(r.gone)) == ("k", 1, b"r") for r in out)
    assert any(r.text is None for r in out) and sum(r["__dropped"] > 0 for r in out) > 30


def test_other_limits(spark):
    df = spark.createDataFrame([(1, "ab\ncd"), (2, "ab"), (3, "x\nAB ")], "n long, body string")
    assert sorted(map(tuple, lines.deduped(df, "n", "body", 2, 3).collect())) == [(1, "cd", 2, 1), (2, "", 1, 1), (3, "x\nAB ", 2, 0)]


def test_odd_and_empty_tables(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    assert sorted(str((r.doc_id, r["__lines"], r["__dropped"], r.text or "")) for r in lines.deduped(df).collect()) == sorted(map(str, brute([(r[0], r[1]) for r in corpus()])))
    assert lines.deduped(df.filter("false")).count() == 0
    assert lines.deduped(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0]["__lines"] == 1


def test_keys_have_whole_characters():
    keys, row, line, counts = lines.long_keys(pa.array([None, "", "é" * 40 + "\n" + "é" * 39, " \t" + "A" * 40 + "\x85\r"]), 40)
    assert keys == ["é".encode() * 40, b"a" * 40 + "\x85".encode()] and row.tolist() == [2, 3] and line.tolist() == [0, 0] and counts.tolist() == [1, 1, 2, 1]


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_filter_misses_no_repeat(tasks):
    rng = np.random.default_rng(tasks)
    once, twice = (rng.integers(0, 1 << 64, n, np.uint64) for n in (200_000, 5_000))
    every = rng.permutation(np.concatenate((once, twice, twice)))
    words = 1 << (lines.BITS_EACH * len(every) - 1).bit_length() >> 6
    pair = np.zeros((words // lines.SEGMENT, 2, lines.SEGMENT), np.uint64)
    for part in np.array_split(every, tasks):
        for s, a, b in lines.pieces_of(part, words):
            lines.fold(pair[s], lines._words(lines._packed(a)), b)
    found = lines.met(np.concatenate(pair[:, 1]), once)
    assert lines.met(np.concatenate(pair[:, 1]), twice).all() and found.mean() < 0.005


def test_only_repeats_reach_the_exact_count(spark):
    rows = [(i, "\n".join(f"line {i} {j} that no other document holds at all" for j in range(20))) for i in range(300)] + [(1000 + i, "the one line that ten documents hold, word for word") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    twice = lines.seen_twice(lines._document_keys(df, "text", 40))
    found = lines._suspects(df, spark.sparkContext.broadcast(twice), "doc_id", "text", 40)
    assert 10 <= found.count() < 10 + 0.005 * 6000
    assert found.filter("doc_id >= 1000").count() == 10


def test_a_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(lines, "seen_twice", lambda keys: np.full(lines.SEGMENT, 0xFFFFFFFFFFFFFFFF, np.uint64))
    rows = shared_lines(9)
    out = lines.deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(str((r.doc_id, r["__lines"], r["__dropped"], r.text or "")) for r in out) == sorted(map(str, brute(rows)))


def test_a_filter_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(lines, "BITS_MOST", 1 << 21)
    df = spark.range(300_000).select(F.xxhash64("id").alias("h"))
    twice = lines.seen_twice(df.union(df.filter("h % 100 = 0")))
    assert len(twice) == 1 << 15
    again = df.filter("h % 100 = 0").toPandas().h.to_numpy().view(np.uint64)
    assert lines.met(twice, again).all()
