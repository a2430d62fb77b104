"""The filter audit against sets in plain Python; its SQL is run in test_operators."""

from __future__ import annotations

from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("cellweft.llm")

from cellweft.llm import filter_audit  # noqa: E402
from cellweft.llm.filter_audit import difference, gallop, overlap, union  # noqa: E402

IDS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(IDS, max_size=5), IDS)
def test_merges(lists, less):
    assert union(lists) == sorted(set().union(*lists))
    for ids in lists:
        assert difference(ids, less) == sorted(set(ids) - set(less))
        assert overlap(ids, less) == len(set(ids) & set(less))
    for at in range(len(less)):
        for x in range(-1, 62):
            assert gallop(less, x, at) == max(at, sum(i < x for i in less))


def brute(rows, names, marks):
    out = []
    for part in {r[0] for r in rows}:
        own = [(set(f), m) for p, f, m in rows if p == part]
        shapley = dict.fromkeys(names, 0)
        lines = []
        for order in permutations(names):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in own)
                shapley[f] += len(gone)
                lines.append((f, part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in own), *[sum(m in r[1] for r in gone) for m in marks]))
        out += [(*line[1:], shapley[line[0]]) for line in lines]
    return sorted(out)


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 16)  # many ranges, parts over several
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["en", "en", "en", "de", ""]), "".join(f for f in "XYZ" if rng.random() < 0.4), rng.choice(["", "g", "t", "gt"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, fails string, mark string").repartition(3)
    has = lambda c, x: F.col(c).contains(x)
    got = filter_audit.audit_filters(df, {f: has("fails", f) for f in "XYZ"}, {"good": has("mark", "g"), "toxic": has("mark", "t")})
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good", "toxic", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(rows, "XYZ", "gt")


def test_facts_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, part string, words string, n int, row int"
    long = "ab " * 300_000
    rows = [(5, "a  b a", "en"), (3, "a  b a", "de"), (3, "a  b a", "en"), (None, "a  b a", None), (None, "x", "en"), (None, "x", "en"), (6, None, ""), (7, "", None), (8, "A\u00c9#\t\x0bb", "en"), (9, long, "en")]
    docs = spark.createDataFrame([(*r, "p", "w", 1, 2) for r in rows], schema)
    got = {(r.doc_id, r.part, r.chars): r for r in filter_audit.text_facts(docs).collect()}
    assert got[5, "en", 6].repeats and got[None, "", 6].repeats and not got[3, "de", 6].repeats and not got[3, "en", 6].repeats
    assert not got[None, "en", 1].repeats and not got[6, "", 0].repeats and got[7, "", 0].repeats
    odd = got[8, "en", 6]
    assert (odd.words, odd.distinct_words, odd.capitals, odd.symbols) == (2, 2, 1, True)
    assert (got[5, "en", 6].words, got[5, "en", 6].distinct_words) == (3, 2)
    assert (got[9, "en", len(long)].words, got[9, "en", len(long)].distinct_words) == (300_000, 1)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.label_marks(labels).collect())) == [(3, False, False), (5, True, True)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    facts = filter_audit.text_facts(docs)
    assert filter_audit.audit_filters(facts, {"A": F.col("words") < 3}, {}).count() == 0
