"""Training and prediction as Spark jobs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.operators.labels import label_intervals, label_runs
from helixlake.operators.segments import block_means, mean_segments, scored_sums
from helixlake.operators.windows import sequence_windows, window_labels
from helixlake.plans import kernels
from helixlake.sources.config import Config, require
from helixlake.sources.fasta import read_fasta
from helixlake.sources.gff import read_gff, write_bedgraph, write_gff
from helixlake.sources.model import load_model, new_model, save_model


#: Doubles in the attention weights of the windows that a task scores at once.
ATTENTION_CELLS = 1 << 22
#: Bases of a sequence whose probabilities travel and are averaged together.
BLOCK = 4096
#: Doubles of a gradient that travel together.
CHUNK = 1 << 16
#: Windows of a batch that a task takes, and those of all batches that a partition holds, about.
SLICE, HELD = 64, 2048
#: Doubles in the attention weights of the windows whose gradients are worked out together: what fits a cache.
STEP_CELLS = 1 << 17
#: Multiplications of a step up to which it isn't worth a Spark job, and windows of the steps that follow each other in one task.
LIGHT, SECTION = 1 << 28, 1 << 15
#: Bytes that a task of many small steps allocates once, untouched: glibc then keeps up to twice as much of what is freed, and
#: arrays of a step don't fault their pages in each time.
KEPT = 30 << 20
#: What a gradient needs of a window.
WINDOW = ["ord", "strand", "seq", "win_start", "labels"]


def scored_blocks(wins: DataFrame, params: kernels.Params, config: Config) -> DataFrame:
    """(ord, seqid, block, first, p0, p1, p2, n): the class probabilities of the bases of windows, as arrays that start at
    position ``first``, cut where blocks of BLOCK positions end; those of neighbouring windows are added up.

    Windows of one length are scored together, as many as ATTENTION_CELLS allows, or one.
    """
    shared = wins.sparkSession.sparkContext.broadcast(params)
    heads, window, scales = config.num_heads, config.window_size, config.cwt_scales

    def score(some: pd.DataFrame) -> np.ndarray:
        p, seqs, sizes = shared.value, some["seq"].to_numpy(), some["size"].to_numpy()
        ends = np.cumsum(sizes)
        values = np.empty((kernels.LABELS, ends[-1]))
        for n in np.unique(sizes):
            same = np.flatnonzero(sizes == n)
            step = max(1, ATTENTION_CELLS // (heads * int(n) ** 2))
            for at in range(0, len(same), step):
                rows = same[at : at + step]
                logits, _ = kernels.forward(p, kernels.features(list(seqs[rows]), scales), heads, window)
                places = (ends[rows] - n)[:, None] + np.arange(n)
                values[:, places] = np.moveaxis(kernels.softmax(logits), -1, 0)
        return values

    return scored_sums(wins.select(F.col("ord").cast("bigint").alias("ord"), F.col("id").alias("seqid"), "win_start", F.col("win_len").alias("size"), "seq"), score, BLOCK)


def _scored(contigs: DataFrame, params: kernels.Params, config: Config) -> tuple[DataFrame, DataFrame]:
    """The scored blocks of sequences (ord, id, seq, length), or of chunks of them with a halo of a window, and the sequences."""
    wins = sequence_windows(contigs, config.window_size, config.window_overlap, "predict")
    return scored_blocks(wins, params, config), contigs.where("chunk_start = 0") if "chunk" in contigs.columns else contigs


def predictions(contigs: DataFrame, params: kernels.Params, config: Config) -> DataFrame:
    """(seqid, ord, pos, p0, p1, p2, n) of every base of every sequence, forward strand.

    ``contigs`` are sequences (ord, id, seq, length), or chunks of them with a halo of a window.
    """
    return block_means(*_scored(contigs, params, config), BLOCK)


def predicted_segments(contigs: DataFrame, params: kernels.Params, config: Config) -> DataFrame:
    """The segments of ``predictions``, without a row per base."""
    return mean_segments(*_scored(contigs, params, config), BLOCK)


def predict(spark: SparkSession, config: Config, strip_whitespace: bool = False) -> DataFrame:
    """Segments of the configured sequences, written as GFF3, with a BedGraph if one is asked for.

    What comes back is computed again where it is used: the probabilities are kept only while they are written.
    """
    require(config, "predict")
    params = load_model(spark, config, config.model_path)
    scored, contigs = _scored(read_fasta(spark, config.predict_fasta, strip_whitespace), params, config)
    scored = scored.persist()
    cut = mean_segments(scored, contigs, BLOCK)
    write_gff(cut, config.output_gff)
    if config.output_bedgraph:
        write_bedgraph(block_means(scored, contigs, BLOCK), config.output_bedgraph)
    scored.unpersist()
    return cut


def training_windows(contigs: DataFrame, features: DataFrame, config: Config) -> DataFrame:
    """Windows of both strands with the labels of their bases in reading order."""
    runs = label_runs(label_intervals(features, contigs), ["seqid", "strand"])
    both = [sequence_windows(contigs, config.window_size, config.window_overlap, "train", strand) for strand in ("+", "-")]
    return window_labels(both[0].unionByName(both[1]), runs, config.window_size)


def _summed_gradients(p: kernels.Params, windows: kernels.Packed, config: Config, seed: int) -> np.ndarray:
    """[loss, windows, gradients in order of the parameters] summed over packed windows, those of like lengths together."""
    total = np.zeros(2 + sum(v.size for v in p.values()))
    (ords, reverse, starts, lengths, codes, labels), heads = windows, config.num_heads
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for some in kernels.groups(lengths.tolist(), heads, STEP_CELLS):
        rows = slice(some[0], some[-1] + 1)
        bases = slice(ends[rows.start], ends[rows.stop])
        x, y = kernels.laid_flat(codes[bases], labels[bases], lengths[rows], config.cwt_scales)
        places = [v[rows][:, None, None] for v in (ords, starts, reverse)]
        logits, caches = kernels.forward(p, x, heads, config.window_size, config.dropout_rate, (seed, *places), lengths[rows])
        losses, delta = kernels.loss_and_gradient(logits, y, lengths[rows])
        grads = kernels.backward(p, x, caches, delta, heads)
        total += np.concatenate([[losses.sum(), len(some)], *(grads[name].ravel() for name in p)])
    return total


def _packed(rows: pd.DataFrame) -> kernels.Packed:
    return kernels.packed(*(rows[c].tolist() for c in WINDOW))


def _shaped(flat: np.ndarray, params: kernels.Params) -> tuple[kernels.Params, float, int]:
    out, at = {}, 2
    for name, v in params.items():
        out[name] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return out, float(flat[0]), round(flat[1])


def gradients(wins: DataFrame, params: kernels.Params, config: Config, seed: int) -> tuple[kernels.Params, float, int]:
    """Sum of the windows' gradients, of their losses, and their number: summed in tasks, then by Spark in
    chunks of CHUNK numbers.

    What comes back is as large as the model.
    """
    shared = wins.sparkSession.sparkContext.broadcast(params)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if batch.empty:
                continue
            one = _summed_gradients(shared.value, _packed(batch), config, seed)
            total = one if total is None else total + one
        if total is not None and total[1]:
            for chunk, at in enumerate(range(0, len(total), CHUNK)):
                yield pd.DataFrame({"chunk": [chunk], "v": [total[at : at + CHUNK]]})

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1], "v": [np.sum(np.stack(part["v"]), axis=0)]})

    made = wins.select(*WINDOW).mapInPandas(partial, "chunk int, v array<double>")
    chunks = made.groupBy("chunk").applyInPandas(summed, "chunk int, v array<double>").collect()
    shared.destroy()
    flat = np.concatenate([r["v"] for r in sorted(chunks)]) if chunks else np.zeros(2 + sum(v.size for v in params.values()))
    return _shaped(flat, params)


def _dealt(parts: int, *more: Column) -> Column:
    """The part of 0..parts-1 that a window falls to, by its hash."""
    return F.pmod(F.xxhash64("id", F.col("ord").cast("int"), "strand", "win_idx", *more), F.lit(parts))


class Dealt:
    """Windows dealt to partitions by batch and slice, as one packed element for each: a step runs as many tasks as its batch
    has slices, on the partitions that hold them, and on no other."""

    def __init__(self, wins: DataFrame, batches: int, windows: int, config: Config) -> None:
        self.context, self.config = wins.sparkSession.sparkContext, config
        slices = max(1, min(self.context.defaultParallelism, -(-config.batch_size // SLICE)))
        placed = wins.select(*WINDOW, _dealt(batches).alias("batch"), _dealt(slices, F.lit(1)).alias("slice"))

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for batch, rows in frame.groupby("batch"):
                    yield pd.DataFrame({"batch": [batch], "data": [pickle.dumps(list(rows[WINDOW].itertuples(index=False, name=None)))]})

        dealt = placed.repartition(max(1, -(-windows // HELD)), "batch", "slice").mapInPandas(packed, "batch bigint, data binary")
        self.rows = dealt.rdd.map(lambda r: (r["batch"], bytes(r["data"]))).persist(StorageLevel.MEMORY_AND_DISK)
        self.places: dict[int, list[int]] = {}
        for batch, place in self.rows.mapPartitionsWithIndex(lambda k, rows: {(row[0], k) for row in rows}).collect():
            self.places.setdefault(batch, []).append(place)

    def gradients(self, batch: int, params: kernels.Params, seed: int) -> tuple[kernels.Params, float, int]:
        """As ``gradients`` of the batch's windows. Small models come back by task; of large ones Spark sums chunks first."""
        size = 2 + sum(v.size for v in params.values())
        if batch not in self.places:
            return _shaped(np.zeros(size), params)
        shared, config = self.context.broadcast(params), self.config

        def partial(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
            mine = [w for b, data in rows if b == batch for w in pickle.loads(data)]
            if mine:
                yield _summed_gradients(shared.value, kernels.packed(*zip(*mine)), config, seed)

        if size <= CHUNK:
            flat = sum(self.context.runJob(self.rows, partial, sorted(self.places[batch])))
        else:
            cut = lambda v: ((at // CHUNK, v[at : at + CHUNK]) for at in range(0, len(v), CHUNK))
            chunks = self.rows.mapPartitions(lambda rows: (c for v in partial(rows) for c in cut(v))).reduceByKey(lambda a, b: a + b).collect()
            flat = np.concatenate([v for _, v in sorted(chunks, key=lambda c: c[0])])
        shared.destroy()
        return _shaped(flat, params)


class Training(NamedTuple):
    """What a step changes, and the loss and the windows of the epoch so far."""

    params: kernels.Params
    state: dict
    step: int
    loss: float = 0.0
    windows: int = 0

    def after(self, grads: kernels.Params, loss: float, count: int, config: Config) -> Training:
        """After an Adam step on the mean of the gradients; parameters and moments change in place. No windows are no step."""
        if not count:
            return self
        mean = {name: g / count for name, g in grads.items()}
        kernels.adam(self.params, mean, self.state, self.step + 1, config.adam_learning_rate, config.adam_beta1, config.adam_beta2, config.adam_epsilon)
        return Training(self.params, self.state, self.step + 1, self.loss + loss, self.windows + count)


def light(p: kernels.Params, bases: int, squares: int, batches: int, config: Config) -> bool:
    """Whether a step, by the bases of all windows and the squares of their lengths, takes less work than a Spark job's start
    costs: at most LIGHT multiplications, forward and backward, for a model that is small itself."""
    matrices = sum(v.size for v in p.values())
    work = 3 * (bases * matrices + squares * 2 * config.num_encoder_layers * config.d_model)
    return matrices <= CHUNK and work <= LIGHT * batches


def _chained(wins: DataFrame, order: np.ndarray, now: Training, config: Config, seed: int) -> Training:
    """``now`` after the steps of an epoch, whose batches come in ``order``.

    The windows are dealt and packed by all tasks, so that a partition holds about SECTION windows of steps that follow each
    other. One task takes those steps, the next one goes on with what it hands over: a job for each section and not for
    each step, whose start would take longer than the step.
    """
    context, each = wins.sparkSession.sparkContext, max(1, SECTION // max(1, config.batch_size))
    sections = -(-len(order) // each)
    shared = context.broadcast(np.argsort(order))

    @F.pandas_udf("bigint")
    def place(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.value[batch.to_numpy()])

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        one = lambda: pd.DataFrame({"data": [pickle.dumps(_packed(pd.concat(held)))]})
        for frame in frames:
            for k, rows in frame.groupby("place"):
                if held and held[0]["place"].iloc[0] != k:
                    yield one()
                    held = []
                held.append(rows)
        if held:
            yield one()

    placed = wins.select(*WINDOW, place(_dealt(len(order))).alias("place"))
    dealt = placed.repartitionById(sections, F.floor(F.col("place") / each).cast("int")).sortWithinPartitions("place")
    rows = dealt.mapInPandas(packed, "data binary").rdd.map(lambda r: bytes(r["data"])).persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    for section in range(sections):
        before = context.broadcast(now)

        def steps(rows: Iterator[bytes]) -> Iterator[Training]:
            np.empty(KEPT, dtype=np.uint8)
            # a task that runs again begins with the same numbers
            now = before.value._replace(params={name: v.copy() for name, v in before.value.params.items()}, state=dict(before.value.state))
            for data in rows:
                flat = _summed_gradients(now.params, pickle.loads(data), config, seed * 1_000_003 + now.step)
                now = now.after(*_shaped(flat, now.params), config)
            yield now

        [now] = context.runJob(rows, steps, [section])
        before.destroy()
    rows.unpersist()
    shared.destroy()
    return now


def _saved_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose tables are whole: a folder counts only with the mark of its committed write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    mark = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=") and system.exists(mark(n)))


def save_state(spark: SparkSession, path: str, epoch: int, params: kernels.Params, state: dict, step: int, losses: list[tuple]) -> None:
    """Parameters and moments after an epoch, with the steps so far and the losses, as one table."""
    rows = []
    for k, (name, v) in enumerate(params.items()):
        m, u = state.get(name, (np.zeros_like(v), np.zeros_like(v)))
        rows.append((k, name, *v.shape, v.ravel().tolist(), m.ravel().tolist(), u.ravel().tolist(), step, losses))
    kind = "ord int, name string, rows int, cols int, data array<double>, m array<double>, u array<double>, step int, losses array<struct<epoch:int,loss:double,windows:int>>"
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def load_state(spark: SparkSession, path: str, epoch: int) -> tuple[kernels.Params, dict, int, list[tuple]]:
    rows = spark.read.parquet(f"{path}/epoch={epoch}").orderBy("ord").collect()
    array = lambda r, c: np.array(r[c]).reshape(r["rows"], r["cols"])
    params = {r["name"]: array(r, "data") for r in rows}
    state = {r["name"]: (array(r, "m"), array(r, "u")) for r in rows}
    return params, state, rows[0]["step"], [tuple(x) for x in rows[0]["losses"]]


def window_losses(wins: DataFrame, params: kernels.Params, config: Config) -> DataFrame:
    """(id, ord, strand, win_idx, loss): mean cross-entropy of each window, without dropout."""
    heads, window, scales = config.num_heads, config.window_size, config.cwt_scales
    shared = wins.sparkSession.sparkContext.broadcast(params)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for batch in batches:
            found, seqs, labels = np.zeros(len(batch)), list(batch["seq"]), list(batch["labels"])
            for some in kernels.groups([len(s) for s in seqs], heads, ATTENTION_CELLS):
                x, y, lengths = kernels.laid_out([seqs[k] for k in some], [labels[k] for k in some], scales)
                found[some] = kernels.loss_and_gradient(kernels.forward(p, x, heads, window, lengths=lengths)[0], y, lengths)[0]
            yield batch[["id", "ord", "strand", "win_idx"]].assign(loss=found)

    return wins.select("id", "ord", "strand", "win_idx", "seq", "labels").mapInPandas(losses, "id string, ord bigint, strand string, win_idx int, loss double")


def fit(wins: DataFrame, config: Config, seed: int = 0, state_path: str | None = None) -> tuple[kernels.Params, DataFrame]:
    """Weights and (epoch, loss, windows), by synchronous batches of about ``batch_size`` windows.

    Every step sums the gradients of its batch and applies one Adam step to their mean; with a batch per window the
    steps are those of training window by window, in another order. Epochs take the batches in an order of their own.
    The gradients are summed over the cluster: windows are kept by batch, so that a step's tasks read the partitions of
    its batch alone. Steps of less work than a Spark job's start (``light``) follow each other in tasks instead.

    With ``state_path`` parameters and moments are written after each epoch; a job that begins again with the same
    windows, settings and seed goes on after the last epoch that was written, with the same steps and losses.
    """
    spark = wins.sparkSession
    params, state, step, losses, done = new_model(config, seed), {}, 0, [], 0
    if state_path and (saved := _saved_epochs(spark, state_path)):
        done = saved[-1] + 1
        params, state, step, losses = load_state(spark, state_path, saved[-1])
    wins = wins.persist()
    size = F.length("seq").cast("long")
    windows, bases, squares = wins.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * size), F.lit(0))).first()
    batches = max(1, -(-windows // max(1, config.batch_size)))
    chained = light(params, bases, squares, batches, config)
    dealt = None if chained else Dealt(wins, batches, windows, config)
    if not chained:
        wins.unpersist()
    for epoch in range(done, config.num_epochs):
        now, order = Training(params, state, step), np.random.default_rng([seed, epoch]).permutation(batches)
        if chained:
            now = _chained(wins, order, now, config, seed)
        else:
            for b in order:
                now = now.after(*dealt.gradients(int(b), params, seed * 1_000_003 + now.step), config)
        params, state, step = now.params, now.state, now.step
        losses.append((epoch, now.loss / max(now.windows, 1), now.windows))
        if state_path:
            save_state(spark, state_path, epoch, params, state, step, losses)
    wins.unpersist()
    if dealt:
        dealt.rows.unpersist()
    return params, spark.createDataFrame(losses, "epoch int, loss double, windows int")


def train(spark: SparkSession, config: Config, seed: int = 0, strip_whitespace: bool = False, state_path: str | None = None) -> DataFrame:
    """Fits a model to the configured sequences and annotations and saves it; gives the losses. With ``state_path`` a
    job that was stopped goes on after its last epoch."""
    require(config, "train")
    wins = training_windows(read_fasta(spark, config.train_fasta, strip_whitespace), read_gff(spark, config.train_gff), config)
    params, losses = fit(wins, config, seed, state_path)
    save_model(spark, params, config, config.model_path)
    return losses
