"""Scans and runs in blocks, joins by bins, windows from chunks."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from helixlake.operators import intervals, labels, scan, segments, windows


@pytest.fixture(params=[1_000_000, 0])
def either(request, monkeypatch):
    """Keys as groups, and all of them cut into blocks."""
    monkeypatch.setattr(scan, "HEAVY_ROWS", request.param)
    monkeypatch.setattr(scan, "HEAVY_TIMES", request.param)
    return request.param


def test_heavy_buckets(spark, monkeypatch):
    monkeypatch.setattr(scan, "HEAVY_ROWS", 500)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    heavy = scan.heavy_buckets(rows, ["k"])
    assert heavy == [spark.range(1).select(scan._bucket(["id"])).first()[0]]


def test_running(spark, either):
    rng = random.Random(3)
    rows = [(k, at, rng.randrange(-5, 6), rng.randrange(100)) for k in "ab" for at in rng.sample(range(-40, 400), 90)] + [("c", 7, 1, 1)]
    df = spark.createDataFrame(rows, "k string, at int, d int, e int")
    found = scan.running(df, ["k"], "at", {"s": "d"}, {"m": "e"}, "next", block=16)
    assert found.columns == ["k", "at", "d", "e", "s", "m", "next"]
    expected = set()
    for k in "abc":
        own = sorted(r for r in rows if r[0] == k)
        for i, r in enumerate(own):
            before = own[:i]
            expected.add((*r, sum(x[2] for x in before) if before else None, max((x[3] for x in before), default=None), own[i + 1][1] if i + 1 < len(own) else None))
    assert {tuple(r) for r in found.collect()} == expected


def brute_runs(rows):
    out = []
    for k in sorted({r[0] for r in rows}):
        last = None
        for _, pos, label in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if last and last[1] == label:
                last[3], last[4] = pos, last[4] + 1
            else:
                last = [k, label, pos, pos, 1]
                out.append(last)
    return {tuple(r) for r in out}


@pytest.mark.parametrize("labels_", [["x"], ["x", "y"], ["x", None, "z"]])
def test_runs(spark, either, labels_):
    """One label through all blocks, runs that end with blocks, null labels."""
    rng = random.Random(len(labels_))
    rows = [(k, p * 3, rng.choice(labels_) if p // 8 % 2 else labels_[0]) for k in "ab" for p in range(200)] + [("c", 5, "x")]
    df = spark.createDataFrame(rows, "k string, pos long, label string")
    assert {(r.k, r.label, r.first, r.last, r.n) for r in segments.runs(df, ["k"], block=24).collect()} == brute_runs(rows)


def test_gaps_and_painted_runs(spark, either):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), b, b + rng.choice((0, 3, 90)), rng.choice([1, 2])) for b in (rng.randrange(2000) for _ in range(150))]
    df = spark.createDataFrame(rows, "k string, b int, e int, label int")
    cut = []
    for k in "ab":
        reached = None
        for _, b, e, _ in sorted(r for r in rows if r[0] == k):
            if reached is not None and reached + 1 <= b - 1:
                cut.append((k, reached + 1, b - 1))
            reached = e if reached is None else max(reached, e)
    assert sorted(tuple(r) for r in labels.gaps(df, ["k"], block=100).collect()) == sorted(cut)
    found = labels.label_runs(df, ["k"], block=100).collect()
    for k in "ab":
        line = [max((r[3] for r in rows if r[0] == k and r[1] <= p <= r[2]), default=0) for p in range(2100)]
        expected = [(p, line[p]) for p in range(2100) if line[p]]
        own = sorted((r.b, r.e, r.label) for r in found if r.k == k)
        assert [(p, x) for b, e, x in own for p in range(b, e + 1)] == expected
        assert all(not (x[2] == y[2] and x[1] + 1 == y[0]) for x, y in zip(own, own[1:]))


def test_one_key_is_dealt_over_tasks(spark, either):
    """The rows that a window's partition holds: a key's where keys are small, else those of a block."""
    df = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("pos"), (F.col("id") % 7 == 0).cast("string").alias("label"))
    assert segments.runs(df, ["k"], block=500).count() == 2 * 2857 + 1
    if not either:
        blocked = scan._blocked(df.withColumnRenamed("pos", "b"), ["k"], "b", 500, scan.heavy_buckets(df, ["k"]))
        assert blocked.groupBy("k", "_block").count().agg(F.max("count"), F.count("*")).first() == (500, 40)


def test_overlapping_intervals(spark):
    rng = random.Random(2)
    spans = [(k, b, b + rng.choice((0, 10, 1000, 70_000, 3_000_000))) for k, b in enumerate(rng.randrange(3_000_000) for _ in range(150))]
    starts = [rng.randrange(6_000_000) for _ in range(200)] + [b for _, b, _ in spans[:20]] + [e for _, _, e in spans[:20]] + [e + 1 for _, _, e in spans[:20]]
    wins = spark.createDataFrame([("s", s, s + rng.randrange(1, 201)) for s in starts], "id string, win_start long, win_end long").distinct()
    right = spark.createDataFrame([("s", *r) for r in spans], "id string, k int, b long, e long")
    found = {(r.win_start, r.win_end, r.k) for r in intervals.overlapping(wins, right, ["id"], 200).collect()}
    expected = {(w.win_start, w.win_end, k) for w in wins.collect() for k, b, e in spans if e >= w.win_start and b < w.win_end}
    assert found == expected and len(expected) > 300


def test_a_long_intron_is_few_rows(spark):
    long = spark.createDataFrame([(0, 999_999), (5, 250_000_000), (0, 0), (255, 256)], "b long, e long")
    assert [r[0] for r in long.select(F.size(intervals.interval_bins(F.col("b"), F.col("e"), 256))).collect()] == [1, 1, 1, 2]
    wins = spark.createDataFrame([(k, k + 200) for k in range(0, 100_000, 777)], "b long, e long")
    assert wins.select(F.size(intervals.touched_bins(F.col("b"), F.col("e"), 256)).alias("n")).agg(F.max("n")).first()[0] <= 2 * intervals.LEVELS + 1


@pytest.mark.parametrize("mode", ["train", "predict"])
def test_windows_from_chunks(spark, mode):
    """Chunks of any size give the windows of whole sequences; also of characters that take more than a byte."""
    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACGTacgtn\n é\U0001f600") for _ in range(n)) for n in (0, 1, 9, 10, 25, 40, 64, 101, 333)]
    contigs = spark.createDataFrame([(k, f"s{k}", s, len(s)) for k, s in enumerate(seqs)], "ord int, id string, seq string, length int")
    for window, overlap, size in ((20, 6, 20), (20, 6, 33), (20, -7, 25), (40, 39, 64), (12, 0, 1 << 16)):
        chunks = windows.sequence_chunks(contigs, window - 1, size)
        assert {(r.id, r.chunk_start): r.chunk[: r.chunk_size] for r in chunks.collect()} == {(f"s{k}", a): s[a : a + max(size, window - 1)] for k, s in enumerate(seqs) for a in range(0, len(s), max(size, window - 1))}
        found = {(r.ord, r.win_idx): (r.win_start, r.win_end, r.win_len, r.seq) for r in windows.chunk_windows(chunks, window, overlap, mode).collect()}
        expected = {}
        rows = contigs.select("ord", "length")
        for r in windows.windows(rows, "length", window, overlap, mode).collect():
            expected[r.ord, r.win_idx] = (r.win_start, r.win_end, r.win_len, seqs[r.ord][r.win_start : r.win_end])
        assert found == expected, (window, overlap, size)
    with pytest.raises(ValueError, match="shorter"):
        windows.sequence_windows(contigs, 20, 20)


def test_windows_of_long_sequences_take_linear_time(spark, tmp_path):
    def seconds(n):
        path = str(tmp_path / str(n))
        text = F.repeat(F.lit("ACGTTGCA"), n // 8)
        spark.range(1).select(F.lit(0).alias("ord"), F.lit("s").alias("id"), text.alias("seq"), F.lit(n).alias("length")).write.parquet(path)
        best = []
        for _ in range(2):
            start = time.time()
            rows = windows.sequence_windows(spark.read.parquet(path), 500, 100).select(F.sum(F.length("seq"))).first()[0]
            best.append(time.time() - start)
        assert rows >= n
        return min(best)

    seconds(1 << 20)
    small, large = seconds(1 << 23), seconds(1 << 24)
    assert large < 2.5 * small + 1
