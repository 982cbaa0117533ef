"""Filter audit against a replay of every order over every document."""

import random
import re
from itertools import permutations

import pytest
from test_llm import DOCS, corpus, prose

from solarweave.llm import audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def fails(rows):
    """(part, id, set of failed filters) of each (id, text, part)."""
    out = []
    for i, t, part in rows:
        t = t or ""
        words, bad = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            bad.add("C")
        if re.search(r"[#$%&*|]", t):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad.add("E")
        out.append((part or "", i, bad))
    return out


def replayed(rows, labels, filters="ABCDE"):
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    judged, out = fails(rows), []
    for part in sorted({p for p, _, _ in judged}):
        docs, total = [x for x in judged if x[0] == part], dict.fromkeys(filters, 0)
        own = []
        for order in permutations(filters):
            left = docs
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                total[f] += len(gone)
                own.append((part, "".join(order), step + 1, len(left), len(gone), sum(f in x[2] for x in docs) - len(gone), sum(x[2] == {f} for x in docs), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone)))
        out += [(*r, total[r[1][r[2] - 1]]) for r in own]
    return sorted(out)


def test_equals_a_replay_of_all_orders(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice((3, 150, 199, 200, 210, 400))) for _ in range(40)]
    texts += [prose(rng, 150) + " same" * n for n in (140, 148, 149, 150, 151, 200)] + [t.upper() for t in texts[:6]] + [t + " 5 % of #" for t in texts[:8]] + [t[:150].title() for t in texts[:8]] + [None, "", " \n\t"]
    rows = [(i, rng.choice(texts), rng.choice(("a", "b", "", None, "é"))) for i in range(160)]
    rows += [rows[3], rows[3], (None, texts[0], "a"), (None, texts[0], "a"), (None, None, None)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 150, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, 1, "x", "y") for i, t, p in rows], "doc_id long, text string, source string, mask int, part string, digest string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audited(docs, marks)
    assert got.columns == COLUMNS and dict(got.dtypes)["step"] == "int" and {dict(got.dtypes)[c] for c in COLUMNS[3:]} == {"bigint"}
    got, want = sorted(map(tuple, got.collect())), replayed(rows, labels)
    assert len(want) == 4 * 600 and got == want
    assert len({r[:3] for r in want}) == len(want) and {f for _, _, b in fails(rows) for f in b} == set("ABCDE")


def test_odd_and_empty_tables(spark):
    docs, marks = spark.createDataFrame(corpus(), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.audited(docs, marks).collect())) == replayed([(r[0], r[1], r[3]) for r in corpus()], [])
    assert audit.audited(docs.filter("false"), marks).count() == 0


@pytest.mark.parametrize("n", [1, 3, 6])
def test_any_number_of_filters(spark, n):
    rng, filters = random.Random(n), "ABCDEF"[:n]
    marked = [("p", rng.randrange(1 << n), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(100)]
    got = {(r.filter_order, r.step): r for r in audit.interactions(spark.createDataFrame(marked, "part string, mask int, good int, toxic int"), filters).collect()}
    total = dict.fromkeys(filters, 0)
    for order in permutations(filters):
        left = marked
        for step, f in enumerate(order):
            bit = 1 << filters.index(f)
            gone = [x for x in left if x[1] & bit]
            left = [x for x in left if not x[1] & bit]
            r = got.pop(("".join(order), step + 1))
            assert (r.kept, r.removed, r.good_lost, r.toxic_lost) == (len(left), len(gone), sum(x[2] for x in gone), sum(x[3] for x in gone))
            total[f] += len(gone)
    assert not got
    assert {r.filter_order: r.shapley for r in audit.interactions(spark.createDataFrame(marked, "part string, mask int, good int, toxic int"), filters).filter("step = 1").collect()} == {"".join(p): total[p[0]] for p in permutations(filters)}
