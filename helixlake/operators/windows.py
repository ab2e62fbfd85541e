"""Sliding windows over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions.binding import let
from helixlake.functions.sequence import reverse_complement, window_text
from helixlake.operators.intervals import overlapping

SHORTEST = 10
#: Bases of a sequence that travel together.
CHUNK = 1 << 16


def step_of(window: int, overlap: int, mode: str) -> int:
    """Bases between window starts. Training falls back to windows side by side; prediction refuses
    an overlap as long as the window, which would never advance; a negative one leaves gaps."""
    if window <= 0:
        raise ValueError("the window must be positive")
    if mode == "train":
        return window - overlap if 0 < overlap < window else window
    if overlap >= window:
        raise ValueError("the overlap must be shorter than the window")
    return window - overlap


def window_starts(length: Column, window: int, overlap: int, mode: str) -> Column:
    """Array of the starts. Training stops at the first window that reaches the end; prediction takes
    every start inside the sequence. Windows of fewer than 10 bases are left out."""
    step = step_of(window, overlap, mode)
    starts = F.when(length > 0, F.sequence(F.lit(0), length.cast("int") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def wanted(s: Column) -> Column:
        long_enough = F.least(length, s + window) - s >= SHORTEST
        if mode != "train":
            return long_enough
        return long_enough & (length >= SHORTEST) & ((s == 0) | (s - step + window < length))

    return F.filter(starts, wanted)


def windows(df: DataFrame, length: str, window: int, overlap: int, mode: str = "predict") -> DataFrame:
    """``df`` with a row per window: win_idx, win_start, win_end (exclusive), win_len. No shuffle."""
    starts = window_starts(F.col(length), window, overlap, mode)
    flat = df.select("*", F.posexplode(starts).alias("win_idx", "win_start"))
    end = F.least(F.col(length), F.col("win_start") + window)
    return flat.withColumns({"win_end": end, "win_len": end - F.col("win_start")})


def sequence_chunks(contigs: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """(ord, id, length, chunk_start, chunk_size, chunk): ``chunk_size`` bases from ``chunk_start`` on and up to
    ``halo`` more, so that what begins in a chunk and is no longer than the halo and a base is whole in it.

    A sequence is cut in one pass, whatever its length, and its chunks are dealt out.
    """
    size = max(size, halo, 1)
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def with_halo(ps: Column) -> Column:
        after = lambda k: F.substr(F.coalesce(F.get(ps, k + 1), F.lit("")), F.lit(1), F.lit(halo))
        return F.transform(ps, lambda p, k: F.struct((k.cast("long") * size).alias("chunk_start"), F.length(p).alias("chunk_size"), F.concat(p, after(k)).alias("chunk")))

    cut = contigs.where("length > 0").select("ord", "id", "length", F.inline(let(pieces, with_halo)))
    return cut.repartition("id", "ord", "chunk_start")


def chunk_windows(chunks: DataFrame, window: int, overlap: int, mode: str = "predict", strand: str = "+") -> DataFrame:
    """(ord, id, strand, win_idx, win_start, win_end, win_len, seq) of the windows that begin in each chunk, whose halo
    has at least ``window`` - 1 bases. Without a shuffle; the work follows the bases of the windows.

    On the reverse strand the window is cut in forward coordinates and then complemented, so its base j lies at
    win_end - 1 - j.
    """
    step, start, length = step_of(window, overlap, mode), F.col("chunk_start"), F.col("length")
    first, last = F.ceil(start / step), F.floor((F.least(start + F.col("chunk_size"), length.cast("long")) - 1) / step)
    numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    s = F.col("_k") * step
    end = F.least(length.cast("long"), s + window)
    wanted = end - s >= SHORTEST
    if mode == "train":
        wanted = wanted & (length >= SHORTEST) & ((s == 0) | (s - step + window < length))
    cut = chunks.select("ord", "id", "length", "chunk_start", "chunk", F.explode(numbers).alias("_k")).where(wanted)
    kind = chunks.schema["length"].dataType
    seq = window_text(F.col("chunk"), s - start, end - s)
    shown = (reverse_complement(seq) if strand == "-" else seq).alias("seq")
    return cut.select("ord", "id", F.lit(strand).alias("strand"), F.col("_k").cast("int").alias("win_idx"), s.cast(kind).alias("win_start"), end.cast(kind).alias("win_end"), (end - s).cast("int").alias("win_len"), shown)


def sequence_windows(contigs: DataFrame, window: int, overlap: int, mode: str = "predict", strand: str = "+") -> DataFrame:
    """``chunk_windows`` of whole sequences (ord, id, seq, length), or of chunks where those are given already."""
    step_of(window, overlap, mode)
    chunks = contigs if "chunk" in contigs.columns else sequence_chunks(contigs, window - 1)
    return chunk_windows(chunks, window, overlap, mode, strand)


def windows_of(pos: Column, length: Column, window: int, overlap: int, mode: str = "predict") -> Column:
    """Numbers of the windows that hold a position: by arithmetic, without a join."""
    step = step_of(window, overlap, mode)
    last = F.floor(pos / step).cast("int")
    first = F.greatest(F.ceil((pos - window + 1) / step), F.lit(0)).cast("int")
    return F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda k: F.array_contains(window_starts(length, window, overlap, mode), k * step))


def window_labels(wins: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """``wins`` with ``labels``: an array of the window's labels in reading order.

    Runs are joined by bins of growing size, so that a long one is two rows at most, then expanded inside each
    window: base j of a reverse window is forward base win_end - 1 - j.
    """
    left = wins.select("id", "strand", "win_idx", "win_start", "win_end")
    met = overlapping(left, runs.select(F.col("seqid").alias("id"), "strand", "b", "e", "label"), ["id", "strand"], window)
    inside = met.groupBy("id", "strand", "win_idx").agg(F.collect_set(F.struct(F.col("b").cast("int").alias("b"), F.col("e").cast("int").alias("e"), "label")).alias("runs"))

    def at(p: Column) -> Column:
        hit = F.filter("runs", lambda r: (r["b"] <= p) & (r["e"] >= p))
        return F.coalesce(F.array_max(F.transform(hit, lambda r: r["label"])), F.lit(0))

    forward = F.transform(F.sequence(F.col("win_start"), F.col("win_end") - 1), at)
    joined = wins.join(inside, ["id", "strand", "win_idx"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<b:int,e:int,label:int>>")))
    return joined.withColumn("labels", F.when(F.col("strand") == "-", F.reverse(forward)).otherwise(forward)).drop("runs")
