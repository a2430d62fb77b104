"""The pipeline's stages against what each promises."""

from __future__ import annotations

import re

import pytest

pytest.importorskip("cellweft.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import pii_brute, shingle_set  # noqa: E402


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if name == "packing":
            break
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if name in ("toxicity", "near duplicates"):
            assert all(before[d] == t for d, t in now.items())
        if name == "near duplicates":
            sets = {d: shingle_set(t) for d, t in now.items()}
            left = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert not left
        if name == "personal data":
            assert set(now) == set(before)
            assert all((before[d] == t) == (not re.search(r"\[(email|ip|card|phone)\]", t)) for d, t in now.items())
            assert not [d for d, t in now.items() if pii_brute(t) and "[" not in t]
        if name == "mixing":
            assert all(before[d] == t for d, t in now.items())
        before = now
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


ODD = [
    (1, "a b c d e f", "s", 6, 1, 2, "x", 0.5, 3, "en", 1),
    (1, "a b c d e f", "s", 6, 1, 2, "x", 0.5, 3, "en", 1),
    (1, "quite another text of words", None, 0, 1, 2, "y", None, None, None, None),
    (2, None, None, 0, 1, 2, "y", None, None, None, None),
    (None, "", "s", 0, 1, 2, "y", None, 0, None, None),
    (None, "mail a@b.co now or never it is", "t", 0, 1, 2, "y", None, 0, None, None),
    (3, "w " * 30_000, "t", 0, 1, 2, "y", None, 0, None, None),
]
CLASHING = "doc_id long, text string, source string, size long, copies int, taken int, found string, score double, n_chars long, lang string, set int"


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_odd_rows_and_clashing_columns(spark, sf_dir, name):
    stage = dict(pipeline.STAGES)[name]
    docs = spark.createDataFrame(ODD, CLASHING)
    out = stage(spark, docs, sf_dir)
    rows = [tuple(r) for r in out.collect()]
    bare = stage(spark, docs.select("doc_id", "text", "source"), sf_dir)  # no n_chars or others
    nothing = stage(spark, docs.limit(0), sf_dir)
    assert nothing.columns == out.columns and nothing.count() == 0
    if name == "packing":
        assert {(r.doc_id, len(r.ids)) for r in out.collect() if r.doc_id == 2} == {(2, 1)}
        return
    assert out.columns == docs.columns and bare.columns == ["doc_id", "text", "source"]
    key = lambda r: tuple(str(x) for x in r)
    if name in ("toxicity", "mixing"):
        assert set(rows) <= set(ODD)
    if name == "toxicity":
        assert len(rows) == len(ODD)
    if name == "near duplicates":  # the two equal rows leave one; rows without words stay
        assert sorted(rows, key=key) == sorted(ODD[1:], key=key)
    if name == "personal data":
        want = [(*r[:8], r[8] if r[1] is None else len(r[1].replace("a@b.co", "[email]")), *r[9:]) for r in ODD]
        want = [(r[0], r[1] and r[1].replace("a@b.co", "[email]"), *r[2:8], None if r[1] is None else r[8], *r[9:]) for r in want]
        assert sorted(rows, key=key) == sorted(want, key=key)


def test_ids_reach_the_end(spark, sf_dir):
    """A training sequence can be built from the last table alone."""
    from cellweft.llm import packing

    docs = spark.createDataFrame([(1, "some words of a text"), (2, "more words " * 3000), (3, None)], "doc_id long, text string")
    got = {}
    for r in pipeline.pack_sequences(spark, docs, sf_dir).collect():
        assert len(r.ids) == r.length
        got.setdefault(r.doc_id, {})[r.start] = r.ids
    e = packing.encoder(packing.vocabulary_path())
    for d, t in docs.collect():
        assert [i for s in sorted(got[d]) for i in got[d][s]] == [*e.ids(t or "").tolist(), 0]
