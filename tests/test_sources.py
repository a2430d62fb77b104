"""Readers on small files."""

import random

import pytest

from cellweft.operators import alignment
from cellweft.sources import readers as R
from cellweft.sources.lines import placed_lines


def _put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_counts(spark, tmp_path):
    m = _put(tmp_path, "m.mtx", "%%MatrixMarket matrix coordinate integer general\n%x\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    b, f = _put(tmp_path, "b.tsv", "c1\nc2\n"), _put(tmp_path, "f.tsv", "g1\tG\ng2\tG\ng3\tG\n")
    got = {(r.cell, r.feature): r.x for r in R.read_counts(spark, m, b, f, "s").collect()}
    assert got == {("c1", "g1"): 5.0, ("c1", "g3"): 2.0, ("c2", "g2"): 7.0}


def test_fragments_and_track(spark, tmp_path):
    p = _put(tmp_path, "f.tsv", "# a comment\nchr1\t1\t5\tc1\t2\nchr2\t3\t9\tc2\t1\n")
    assert R.read_fragments(spark, p, "s", 3).selectExpr("sum(en - st)").first()[0] == 10
    p = _put(tmp_path, "t.bg", "track type=bedGraph\nchr1\t0\t10\t0.5\n")
    assert [tuple(r) for r in R.read_track(spark, p).collect()] == [("chr1", 0, 10, 0.5)]


def test_intervals(spark, tmp_path):
    p = _put(tmp_path, "a.gtf", 'chr1\tx\tgene\t11\t20\t.\t-\t.\tgene_id "g1"; name "A b";\n')
    r = R.read_intervals(spark, p, "gtf").first()
    assert (r.id, r.st, r.en, r.strand, r.attrs["name"]) == ("g1", 10, 20, "-", "A b")
    p = _put(tmp_path, "a.bed", "chr1\t5\t9\tp1\t0\t+\n")
    assert R.read_intervals(spark, p).first().id == "p1"


def test_sequence(spark, tmp_path):
    p = _put(tmp_path, "a.fa", ">chr1 desc\nACGT\nAC\n>chr2\nGGTT\n")
    got = sorted((r.chrom, r.chunk_start, r.seq) for r in R.read_sequence(spark, p, 4, 1).collect())
    assert got == [("chr1", 0, "ACGTA"), ("chr1", 4, "AC"), ("chr2", 0, "GGTT")]


def test_chain(spark, tmp_path):
    p = _put(tmp_path, "a.chain", "chain 1 chrA 1000 + 0 400 chrB 2000 + 500 900 7\n100 20 20\n80 100 0\n100\n\nchain 1 chrA 1000 + 500 600 chrC 300 - 50 150 8\n100\n\n")
    got = sorted((r.chain, r.src_start, r.src_end, r.dst_chrom, r.dst_start, r.dst_end) for r in R.read_align_blocks(spark, p).collect())
    assert got == [(7, 0, 100, "chrB", 500, 600), (7, 120, 200, "chrB", 620, 700), (7, 300, 400, "chrB", 700, 800), (8, 500, 600, "chrC", 150, 250)]


def test_pwm_and_sink(spark, tmp_path):
    p = _put(tmp_path, "m.txt", ">m1 x\n0.1 0.2 0.3 0.4\n1 2 3 4\n")
    pwm = R.read_pwm(spark, p)
    assert {(r.pos, r.base): r.w for r in pwm.collect()}[(1, "G")] == 3.0
    R.write_table(pwm, str(tmp_path / "out"), ["motif"], files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def _split(spark, size):
    """Splits of some `size` bytes, so that small files are cut anywhere between lines."""
    for k, v in (("spark.sql.files.maxPartitionBytes", str(size)), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "64")):
        spark.conf.set(k, v)


@pytest.fixture
def tiny_splits(spark):
    _split(spark, 40)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


def test_sequence_over_many_splits(spark, tmp_path, tiny_splits):
    """Records over several splits, several in one, headers at any place, two files, a record of one name in each."""
    rng = random.Random(3)
    want = []
    for name in ("a.fa", "b.fa"):
        text = "leading text without a record\n" if name == "b.fa" else ""
        for k in range(8):
            seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 5, 59, 60, 61, 300, 700])))
            text += f">chr{k} some words\r\n" if k % 3 else f">chr{k}\n"
            at, step = 0, rng.choice([7, 60])
            while at < len(seq):
                text += seq[at : at + step] + "\n" * rng.choice([1, 1, 2])
                at += step
            want += [(f"chr{k}", s, seq[s : s + 53]) for s in range(0, len(seq), 50)]
        _put(tmp_path, name, text)
    lines = placed_lines(spark, str(tmp_path))
    assert lines.select("file", "split").distinct().count() > 40
    got = R.read_sequence(spark, str(tmp_path), 50, 3).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sequence_edges(spark, tmp_path):
    assert R.read_sequence(spark, _put(tmp_path, "e.fa", ""), 4).count() == 0
    assert R.read_sequence(spark, _put(tmp_path, "h.fa", ">only a header\n"), 4).count() == 0
    long = "ACGTACGTAC" * 1000
    got = R.read_sequence(spark, _put(tmp_path, "one.fa", f">c\n{long}"), 128, 16).orderBy("chunk_start").collect()
    assert "".join(r.seq[:128] for r in got) == long and got[0].seq == long[:144]


MAF = """##maf version=1
# a comment
a score=10.0
s rat.chr1   100 6 + 1000 ACG-TAC
s mouse.chrX  10 7 -  500 ACGGTAC
i mouse.chrX N 0 C 0

a score=2
s rat.chr1 200 4 + 1000 AC-GT
q rat.chr1 99999
s human.chr2.alt 5 3 - 50 A--CG
s bare 0 2 + 9 AC---

a
a score=7
s rat.chr9 0 1 - 10 T
"""


def test_alignments_by_hand(spark, tmp_path, tiny_splits):
    """Both strands, blocks without rows, other kinds of lines, blocks over several splits, two files."""
    _put(tmp_path, "a.maf", MAF)
    _put(tmp_path, "b.maf", "a\ns rat.chr1 7 2 + 10 A-C\n")
    rows = R.read_alignments(spark, str(tmp_path))
    assert placed_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 5
    assert sorted(map(tuple, rows.collect())) == [
        (0, "mouse", "chrX", 483, 490, "-", 500, "ACGGTAC"), (0, "rat", "chr1", 100, 106, "+", 1000, "ACG-TAC"),
        (1, "bare", "bare", 0, 2, "+", 9, "AC---"), (1, "human", "chr2.alt", 42, 45, "-", 50, "A--CG"), (1, "rat", "chr1", 200, 204, "+", 1000, "AC-GT"),
        (3, "rat", "chr9", 9, 10, "-", 10, "T"), (4, "rat", "chr1", 7, 9, "+", 10, "A-C"),
    ]
    # and they feed the alignment operators
    same = {(r.block, r.species): (r.n, r.gaps, r.identity) for r in alignment.align_identity(rows, "rat").collect()}
    assert same[0, "mouse"] == (7, 1, 1.0) and same[1, "human"] == (5, 2, 1 / 3)
    runs = sorted((r.block, r.st, r.en) for r in alignment.align_runs(rows).collect())
    assert (0, 0, 3) in runs and (0, 4, 7) in runs
    at = {(r.block, r.col): (r.chrom, r["at"]) for r in alignment.genome_positions(rows, "mouse").collect()}
    assert at[0, 0] == ("chrX", 489) and at[0, 6] == ("chrX", 483)
    at = {(r.block, r.col): r["at"] for r in alignment.genome_positions(rows, "rat").collect()}
    assert at[0, 2] == 102 and (0, 3) not in at and at[0, 4] == 103 and at[3, 0] == 9
