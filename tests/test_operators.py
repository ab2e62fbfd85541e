"""Labels, windows, segments, matrices."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import numeric, sequence
from helixlake.operators import labels, linalg, segments, windows

CONTIGS = [(0, "c", "A" * 60, 60), (1, "d", "C" * 12, 12)]
FEATURES = [
    ("c", "CDS", 5, 10, "+", "Parent=t1"),
    ("c", "exon", 21, 30, "+", "Parent=t1, t2"),
    ("c", "CDS", 23, 25, "+", "Parent=t1"),
    ("c", "exon", 15, 17, "+", "Parent=t3"),
    ("c", "exon", 41, 99, "+", "Parent=t2"),
    ("c", "cds", 1, 60, "+", "Parent=t1"),
    ("c", "exon", 8, 3, "+", "Parent=t1"),
    ("c", "exon", 0, 2, ".", "ID=t9"),
    ("c", "exon", 50, 52, "?", "ID=t8"),
    ("d", "exon", 13, 14, "-", "ID=far"),
    ("d", "exon", 2, 3, "-", "Parent=;ID=x"),
    ("d", "exon", 6, 7, "-", "Parent=;ID=x"),
    ("other", "exon", 1, 2, "+", "ID=z"),
]


def frames(spark):
    contigs = spark.createDataFrame(CONTIGS, "ord int, id string, seq string, length int")
    features = spark.createDataFrame(FEATURES, "seqid string, feature string, start int, end int, strand string, attributes string")
    return contigs, features


def brute_labels(contigs, features):
    out = {}
    for _, cid, _, n in contigs:
        for strand in "+-":
            line, tx = [0] * n, {}
            for seqid, feature, start, end, mark, attrs in features:
                b, e = max(start - 1, 0), min(end - 1, n - 1)
                if seqid != cid or mark not in (strand, ".") or feature not in ("CDS", "exon") or e < b:
                    continue
                line[b : e + 1] = [2] * (e - b + 1)
                fields = dict(x.strip().split("=", 1) for x in reversed(attrs.split(";")))
                for p in fields.get("Parent", fields.get("ID", "")).split(","):
                    if p.strip():
                        tx.setdefault(p.strip(), []).append((b, e))
            for spans in tx.values():
                spans.sort()
                for (_, e0), (b1, _) in zip(spans, spans[1:]):
                    for k in range(e0 + 1, b1):
                        line[k] = max(line[k], 1)
            out[cid, strand] = line
    return out


def test_labels_against_brute_force(spark):
    contigs, features = frames(spark)
    expected = brute_labels(CONTIGS, FEATURES)
    intervals = labels.label_intervals(features, contigs)
    dense = {}
    for r in labels.dense_labels(intervals, contigs).orderBy("pos").collect():
        dense.setdefault((r.seqid, r.strand), []).append(r.label)
    assert dense == expected
    runs = labels.label_runs(intervals, ["seqid", "strand"])
    painted = {k: [0] * len(v) for k, v in expected.items()}
    for r in runs.collect():
        assert all(painted[r.seqid, r.strand][p] == 0 for p in range(r.b, r.e + 1))
        painted[r.seqid, r.strand][r.b : r.e + 1] = [r.label] * (r.e - r.b + 1)
    assert painted == expected
    counts = {(r.seqid, r.strand): (r.intergenic, r.intron, r.exon) for r in labels.class_counts(runs, contigs).collect()}
    assert counts == {k: tuple(v.count(x) for x in range(3)) for k, v in expected.items()}


def test_painting_tasks_follow_the_positions(spark, monkeypatch):
    """Tasks hold a bounded number of positions; repeated ids have a row each, intervals beyond a line or of no line none."""
    monkeypatch.setattr(labels, "CELLS", 5_000, raising=False)
    contigs = spark.createDataFrame([("a", 50_000), ("b", 3), ("b", 5), ("c", 0)], "id string, length int")
    rows = [("a", "+", 9_990, 20_005, 1), ("a", "+", 9_999, 10_001, 2), ("b", "+", 2, 7, 1), ("b", "-", 0, 0, 2), ("d", "+", 0, 3, 2)]
    intervals = spark.createDataFrame(rows, "seqid string, strand string, b int, e int, label int")
    dense = labels.dense_labels(intervals, contigs, ("+",))
    painted = labels.paint(intervals, ["seqid", "strand"])
    assert dense.rdd.getNumPartitions() >= 10 and painted.rdd.getNumPartitions() >= 2
    line = [2 if 9_999 <= p <= 10_001 else int(9_990 <= p <= 20_005) for p in range(50_000)]
    b = [(0, 0), (0, 0), (1, 0), (1, 0), (2, 1), (2, 1), (3, 1), (4, 1)]
    got = sorted((r.seqid, r.pos, r.label) for r in dense.collect())
    assert got == [("a", p, v) for p, v in enumerate(line)] + [("b", *x) for x in b]
    covered = {("a", "+", p): v for p, v in enumerate(line) if v} | {("b", "+", p): 1 for p in range(2, 8)} | {("b", "-", 0): 2} | {("d", "+", p): 2 for p in range(4)}
    assert {(r.seqid, r.strand, r.pos): r.label for r in painted.collect()} == covered


def test_runs_of_random_intervals(spark):
    rng = random.Random(5)
    rows = [("s", b, b + rng.randrange(8), rng.choice([1, 2])) for b in (rng.randrange(300) for _ in range(60))]
    line = [0] * 320
    for _, b, e, label in rows:
        for k in range(b, e + 1):
            line[k] = max(line[k], label)
    found = [0] * 320
    runs = labels.label_runs(spark.createDataFrame(rows, "k string, b int, e int, label int"), ["k"]).orderBy("b").collect()
    for r in runs:
        found[r.b : r.e + 1] = [r.label] * (r.e - r.b + 1)
    assert found == line
    assert all(not (x.label == y.label and x.e + 1 == y.b) for x, y in zip(runs, runs[1:]))


def brute_windows(n, size, overlap, mode):
    step = (size - overlap if 0 < overlap < size else size) if mode == "train" else size - overlap
    out, start = [], 0
    if mode == "train" and n < 10:
        return out
    while start < n:
        end = min(start + size, n)
        if end - start >= 10:
            out.append((start, end))
        if mode == "train" and end >= n:
            break
        start += step
    return out


@pytest.mark.parametrize("mode", ["train", "predict"])
def test_windows_against_brute_force(spark, mode):
    lengths = [0, 1, 9, 10, 19, 20, 21, 35, 36, 52, 53, 99, 100, 101, 500]
    rows = spark.createDataFrame([(n,) for n in lengths], "n int")
    for size, overlap in ((20, 4), (20, 0), (20, -5), (20, 19), (100, 40)):
        found = {n: [] for n in lengths}
        for r in windows.windows(rows, "n", size, overlap, mode).orderBy("n", "win_start").collect():
            found[r.n].append((r.win_start, r.win_end))
            assert r.win_len == r.win_end - r.win_start
        assert found == {n: brute_windows(n, size, overlap, mode) for n in lengths}, (size, overlap)


def test_window_steps():
    assert windows.step_of(20, 20, "train") == 20
    with pytest.raises(ValueError, match="shorter"):
        windows.step_of(20, 20, "predict")


@pytest.mark.parametrize(("size", "overlap", "counts"), [(200, 40, (31, 32)), (500, 100, (13, 13)), (5000, 1000, (1, 2))])
def test_known_window_counts(spark, size, overlap, counts):
    rows = spark.createDataFrame([(5000,)], "n int")
    assert tuple(windows.windows(rows, "n", size, overlap, mode).count() for mode in ("train", "predict")) == counts


def test_windows_of_position(spark):
    rows = spark.range(95).select(F.col("id").cast("int").alias("pos"), F.lit(95).alias("n"))
    for mode in ("train", "predict"):
        expected = brute_windows(95, 20, 4, mode)
        for r in rows.select("pos", windows.windows_of(F.col("pos"), F.col("n"), 20, 4, mode).alias("ks")).collect():
            assert r.ks == [s // 16 for s, e in expected if s <= r.pos < e]


def test_window_labels_of_both_strands(spark):
    contigs, features = frames(spark)
    expected = brute_labels(CONTIGS, FEATURES)
    runs = labels.label_runs(labels.label_intervals(features, contigs), ["seqid", "strand"])
    for strand in "+-":
        wins = windows.sequence_windows(contigs, 20, 5, "train", strand)
        for r in windows.window_labels(wins, runs, 20).collect():
            line = expected[r.id, strand][r.win_start : r.win_end]
            assert r.labels == (line[::-1] if strand == "-" else line)
            base = {"T": "A", "G": "C"}[r.seq[0]] if strand == "-" else r.seq[0]
            assert base == {"c": "A", "d": "C"}[r.id]


def test_complements(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(40))) for _ in range(20)]
    rows = spark.createDataFrame([(s,) for s in seqs], "s string")
    again = sequence.reverse_complement(sequence.reverse_complement(F.col("s")))
    assert all(r.s == r.again for r in rows.select("s", again.alias("again")).collect())
    odd = spark.createDataFrame([("acgtNRß x",), ("",), (None,)], "s string").select(sequence.complement(F.col("s")).alias("c")).collect()
    assert [r.c for r in odd] == ["TGCANNNNN", "", None]


def test_segments_partition_sequences(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for seqid, ord_, n in (("x", 0, 50), ("y", 1, 33), ("one", 2, 1)):
        line = [rng.choice([0, 0, 1, 2]) for _ in range(n)]
        rows += [(seqid, ord_, p, *[1.0 if k == c else 0.0 for k in range(3)]) for p, c in enumerate(line)]
        expected[seqid] = line
    frame = spark.createDataFrame(rows, "seqid string, ord int, pos int, p0 double, p1 double, p2 double")
    found = {k: [None] * len(v) for k, v in expected.items()}
    cut = segments.segments(frame, block=7).orderBy("ord", "start").collect()
    for r in cut:
        assert all(v is None for v in found[r.seqid][r.start - 1 : r.end])
        found[r.seqid][r.start - 1 : r.end] = [r.label] * (r.end - r.start + 1)
    assert found == expected
    assert all(not (a.seqid == b.seqid and a.label == b.label) for a, b in zip(cut, cut[1:]))


@pytest.mark.parametrize(("p", "label"), [((0.3, 0.3, 0.3), 0), ((0.1, 0.5, 0.5), 1), ((0.2, 0.1, 0.7), 2), ((float("nan"), 0.1, 0.2), 0), ((0.0, 0.0, 0.0), 0)])
def test_class_of_ties(spark, p, label):
    row = spark.createDataFrame([p], "a double, b double, c double").select(numeric.class_of(F.col("a"), F.col("b"), F.col("c")).alias("k")).first()
    assert row.k == label


def test_block_means_fill_tails(spark):
    """A row per base; means where windows overlap; also over the ends of blocks."""
    contigs, _ = frames(spark)
    some = [("c", 0, 0, 3, [0.2], [0.3], [0.5]), ("c", 0, 0, 2, [0.0, 0.4], [0.5, 0.1], [0.5, 0.5]), ("c", 0, 1, 5, [1.0], [0.0], [0.0])]
    scored = spark.createDataFrame(some, "seqid string, ord int, block int, first int, p0 array<double>, p1 array<double>, p2 array<double>")
    rows = segments.block_means(scored, contigs, 5).collect()
    assert len(rows) == len({(r.seqid, r.ord, r.pos) for r in rows}) == 72
    found = {r.pos: (round(r.p0, 9), round(r.p1, 9), round(r.p2, 9), r.n) for r in rows if r.n}
    assert found == {2: (0.0, 0.5, 0.5, 1), 3: (0.3, 0.2, 0.5, 2), 5: (1.0, 0.0, 0.0, 1)}
    assert all((r.p0, r.p1, r.p2) == (0.0, 0.0, 0.0) for r in rows if not r.n)


def matrix(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i int, j int, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


def test_matrices(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 5))
    assert np.allclose(dense(linalg.matmul(matrix(spark, a), matrix(spark, b)), (4, 5)), a @ b)
    assert np.allclose(dense(linalg.transpose(matrix(spark, a)), (3, 4)), a.T)
    assert np.allclose(dense(linalg.scale(linalg.add(matrix(spark, a), matrix(spark, a)), 0.5), (4, 3)), a)
    soft = dense(linalg.row_softmax(matrix(spark, a * 1000), ["i"]), (4, 3))
    assert np.allclose(soft.sum(1), 1)
    constant = spark.createDataFrame([([2.0] * 5,)], "x array<double>").select(numeric.layer_norm(F.col("x")).alias("y")).first().y
    assert constant == [0.0] * 5


def test_window_sums_and_segments_without_a_row_per_base(spark):
    """Windows added up before they are dealt, gaps and ends of blocks included, give the rows of single windows; what a
    task may hold changes nothing."""
    starts = {"a": [0, 3, 6, 30, 33], "b": [0, 5], "c": []}
    rows = [(s, 0, w, 7) for s, ws in starts.items() for w in ws]
    wins = spark.createDataFrame(rows, "seqid string, ord int, win_start int, size int").coalesce(1)
    contigs = spark.createDataFrame([("a", 0, 42), ("b", 0, 12), ("c", 0, 9)], "id string, ord int, length int")

    def score(some):
        return np.concatenate([[[((w + k) * c + w) % 5 / 4.0 for k in range(n)] for c in (1, 2, 3)] for w, n in zip(some["win_start"], some["size"])], axis=1)

    expected = {(s, p): [[], 0] for s, n in (("a", 42), ("b", 12), ("c", 9)) for p in range(n)}
    for s, _, w, n in rows:
        for k in range(n):
            expected[s, w + k][0].append([((w + k) * c + w) % 5 / 4.0 for c in (1, 2, 3)])
            expected[s, w + k][1] += 1
    runs = []
    for cells in (1, 10, 1000):
        scored = segments.scored_sums(wins, score, 8, cells)
        if cells == 1000:
            assert scored.count() < scored.selectExpr("inline(arrays_zip(p0, n))").selectExpr("sum(n)").first()[0] / 7 + 8  # fewer than pieces of windows
        means = segments.block_means(scored, contigs, 8)
        found = {(r.seqid, r.pos): r for r in means.collect()}
        assert found.keys() == expected.keys()
        for key, (values, n) in expected.items():
            assert found[key].n == n
            assert np.allclose([found[key].p0, found[key].p1, found[key].p2], np.mean(values, axis=0) if values else 0)
        one = sorted(map(tuple, segments.mean_segments(scored, contigs, 8).collect()))
        assert one == sorted(map(tuple, segments.segments(means).collect()))
        few = segments.reduced_blocks(scored, contigs, 8, "n bigint", lambda first, p, n: [(int(n.sum()),)], cells)
        assert few.count() == 6 + 2 + 2 and few.groupBy().sum("n").first()[0] == 7 * len(rows)
        runs.append(one)
    assert runs[0] == runs[1] == runs[2]
