"""Passages whose chunks a third document holds still earlier."""

import random

import numpy as np
import pytest
from test_llm import first_places, prose

from solarweave.llm import substring


def nested(n, seed=1, size=240, inner=150):
    """Passages of size bytes in documents b and c of each group; their middle is also in an earlier a, and once more between them."""
    rng, rows, at = random.Random(seed), [], []
    noise = lambda k: " ".join(f"{w}{rng.randrange(10**6)}" for w in prose(rng, k).split())
    for i in range(n):
        p = noise(60)[:size]
        cut = (size - inner) // 2
        middle = p[cut : cut + inner]
        rows += [(10 * i, f"{noise(9)} {middle} {noise(9)}"), (10 * i + 1, f"{noise(7)} {p} {noise(3)}"), (10 * i + 2, f"{noise(4)} {middle} {noise(12)}"), (10 * i + 3, f"{noise(11)} {p} {noise(5)}"), (10 * i + 4, f"{noise(5)} {middle} {noise(5)}")]
        at.append((10 * i + 3, p))
    return rows, at


@pytest.mark.parametrize("size,inner", [(240, 150), (205, 140), (400, 190)])
def test_nested_passages_are_found(spark, size, inner):
    rows, want = nested(60, size, size, inner)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, texts = substring.repeats(df, within=False).collect(), dict(rows)
    held = {}
    for r in got:
        assert r.stop - r.start >= substring.LEAST_RUN
        held.setdefault(r.doc_id, []).append(texts[r.doc_id].encode()[r.start : r.stop].decode())
    found = [d for d, p in want if any(p in x for x in held.get(d, ()))]
    assert set(held) <= {d for d, _ in want} and len(found) >= (len(want) if size >= 240 else 0.95 * len(want))  # the shortest may hold no whole chunk


def test_repeats_with_nested_passages_equal_brute_force(spark):
    rows, _ = nested(12, 5)
    rng = random.Random(6)
    rows += [(200 + i, " ".join(rng.choice(rows)[1][k : k + rng.randint(100, 300)] for k in (0, 20))) for i in range(40)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string"), within=False).collect()
    want, mine = first_places(rows), {d: np.zeros(len(t.encode()), bool) for d, t in rows}
    for r in got:
        mine[r.doc_id][r.start : r.stop] = True
    missing = sum((want[d] & ~mine[d]).sum() for d, _ in rows)
    assert sum(w.sum() for w in want.values()) > 3000 and missing <= 4 * len(rows)


def test_nested_passages_within_a_text(spark):
    rows, want = nested(10, 3)
    whole = " | ".join(t for _, t in rows)
    (first,) = {r.doc_id for r in substring.repeats(spark.createDataFrame([(7, whole)], "doc_id long, text string")).collect()}
    got = [whole.encode()[r.start : r.stop].decode() for r in substring.repeats(spark.createDataFrame([(7, whole)], "doc_id long, text string")).collect()]
    assert first == 7 and all(any(p in x for x in got) for _, p in want)
    assert substring.repeats(spark.createDataFrame([(7, whole)], "doc_id long, text string"), within=False).count() == 0
