"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by phrase, and their scores.

A shard holds up to ``SHARD_WORDS`` words of one language as ids, a zero between pieces. Prefix doubling sorts its
places; the intervals of the longest common prefixes are its phrases and their counts. As a phrase is no more
frequent than the words and pairs of words in it, a first pass asks for these alone, by hash: which of a shard's
reach the least count over all shards. A second pass gives the counts of those, and of longer phrases all of whose pairs
reach it. They are merged by their text, so that a hash that two phrases share lets one too many through and changes no
count. Buckets of hashes travel as arrays, and texts compressed in the order of the suffixes.

Defined results: a null language is ``und``; a null or empty text has no words; rows that repeat count each time; ids
and further columns are not looked at; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import discard, positions, release, stored

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Words of a shard. A text is never cut, so that one with more is a shard of its own.
SHARD_WORDS = 1 << 20
#: Words of the corpus to one bucket of phrases. A bucket holds no more different phrases of a kind, and of each one
#: entry a shard at most. Inside it 32 bits tell phrases apart.
BUCKET_WORDS = 1 << 19

_SMALL = bytes(range(65, 91)).lower()
#: A-Z lower-cased, ends of pieces as line feeds, tabs as blanks.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", _SMALL + b"\n" * 9 + b" ")
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)

SHARD = "shard long, lang string, n long, ids binary, words binary"
ASKED = "bucket long, shard long, hashes binary, counts binary"
ANSWERED = "bucket long, shard long, often binary"
COUNTED = "bucket long, lang string, phrases binary, counts binary"
MERGED = "lang string, phrase string, words int, n long"


class _Ids(dict):
    """Ids of words in order of arrival; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


def packed(ids: np.ndarray) -> bytes:
    """Numbers of four bytes, all first bytes before all second ones, compressed."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def word_ids(text: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """The ids of a text's words, with zeros at the ends of its pieces."""
    words = list(filter(None, text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ")))
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, end = TaskContext.get().partitionId(), 0, np.zeros(1, dtype=np.int32)
    known: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
    held: dict[str, int] = {}

    def made(lang: str) -> pa.RecordBatch:
        nonlocal number
        ids, parts = known.pop(lang)
        del held[lang]
        flat = np.concatenate(parts)
        number += 1
        words = list(ids)[1:]
        row = [[part << 32 | number], [lang], [int(np.count_nonzero(flat))], [packed(flat)], [zstandard.compress(b" ".join(words))]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(v, kind) for v, kind in zip(row, kinds)], names=["shard", "lang", "n", "ids", "words"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in known:
                known[lang], held[lang] = (_Ids(), []), 0
            ids, parts = known[lang]
            parts += [word_ids(text, ids), end]
            held[lang] += len(parts[-2]) + 1
            if sum(held.values()) >= SHARD_WORDS:
                yield made(max(held, key=held.get))
    for lang in list(known):
        yield made(lang)


def suffix_array(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the words that follow, ``longest`` of them at least, and how many words, up to
    ``longest`` and up to the end of a piece, each shares with the place before."""
    names, span, n = ids.astype(np.int64), 1, len(ids)
    order = np.argsort(names)
    while span < longest:
        key = names << 32
        key[: n - span] |= names[span:]
        order = np.argsort(key)
        ranked = key[order]
        names = np.empty(n, dtype=np.int64)
        names[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
        span *= 2
    padded = np.r_[ids, np.zeros(longest, dtype=ids.dtype)]
    shared, same = np.zeros(n, dtype=np.int8), np.ones(max(n - 1, 0), dtype=bool)
    for d in range(longest):
        here = padded[order + d]
        same &= (here[1:] == here[:-1]) & (here[1:] > 0)
        shared[1:] += same
    return order, shared


def phrases(ids: np.ndarray, order: np.ndarray, shared: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the intervals of phrases of n words: first place in the array, size, and whether no piece ends in them."""
    starts = np.flatnonzero(shared < n)
    padded = np.r_[ids, np.zeros(n, dtype=ids.dtype)]
    inside = np.ones(len(starts), dtype=bool)
    for d in range(n):
        inside &= padded[order[starts] + d] > 0
    return starts, np.diff(np.r_[starts, len(order)]), inside


def phrase_hashes(ids: np.ndarray, words: list[bytes], lang: str, at: np.ndarray, n: int) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang, n)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(at), dtype=np.uint64)
    for d in range(n):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashed[ids[at + d] - 1]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(32))


def _dealt(hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket that is stable, the buckets that have any, and where each begins, the end last."""
    bucket = ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    named, firsts = np.unique(bucket[order], return_index=True)
    return order, named, np.r_[firsts, len(order)]


def _table(kinds: list[pa.DataType], names: list[str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def _read(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, str, np.ndarray, list[bytes]]]:
    """Shard, language, ids and words of each row, one at a time."""
    for k in range(batch.num_rows):
        shard, lang, ids, words = (batch.column(c)[k].as_py() for c in ("shard", "lang", "ids", "words"))
        yield shard, lang, unpacked(ids), zstandard.decompress(words).split(b" ")


def _asking(buckets: int, least: int):
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of a shard's words and pairs by bucket, with their counts up to the least one."""
        for batch in batches:
            for shard, lang, ids, words in _read(batch):
                order, shared = suffix_array(ids, 2)
                hashes, counts = [], []
                for n in (1, 2):
                    starts, sizes, inside = phrases(ids, order, shared, n)
                    hashes.append(phrase_hashes(ids, words, lang, order[starts[inside]], n))
                    counts.append(np.minimum(sizes[inside], least).astype(np.uint8))
                hashed, counted = np.concatenate(hashes), np.concatenate(counts)
                dealt, named, edges = _dealt(hashed, buckets)
                short, counted = hashed[dealt].astype(np.uint32), counted[dealt]
                rows = [(int(b), shard, short[i:j].tobytes(), counted[i:j].tobytes()) for b, i, j in zip(named, edges, edges[1:])]
                yield from _table([pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "shard", "hashes", "counts"], rows).to_batches()

    return asked


def _answering(least: int):
    def answered(bucket: pa.Table) -> pa.Table:
        """Which of each shard's hashes reach the least count over all shards, as a bit each, in the order asked."""
        parts = [np.frombuffer(h, dtype=np.uint32) for h in bucket["hashes"].to_pylist()]
        hashed = np.concatenate(parts)
        counts = np.frombuffer(b"".join(bucket["counts"].to_pylist()), dtype=np.uint8)
        order = np.argsort(hashed)
        ranked = hashed[order]
        starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        often = np.add.reduceat(counts[order].astype(np.int64), starts) >= least
        wanted = np.zeros(len(hashed), dtype=bool)
        wanted[order] = np.repeat(often, np.diff(np.r_[starts, len(ranked)]))
        rows, at = [], 0
        for number, shard, part in zip(bucket["bucket"].to_pylist(), bucket["shard"].to_pylist(), parts):
            rows.append((number, shard, np.packbits(wanted[at : at + len(part)]).tobytes()))
            at += len(part)
        return _table([pa.int64(), pa.int64(), pa.binary()], ["bucket", "shard", "often"], rows)

    return answered


def _counting(longest: int, least: int, buckets: int):
    def counted(shard: pa.Table, answers: pa.Table) -> pa.Table:
        """A shard's words and pairs that reach the least count, and longer phrases made of them, by bucket."""
        rows = []
        for _, lang, ids, words in _read(shard):
            named = pa.array(words, pa.binary())
            bits = dict(zip(answers["bucket"].to_pylist(), answers["often"].to_pylist()))
            order, shared = suffix_array(ids, longest)
            found = [phrases(ids, order, shared, n) for n in range(1, longest + 1)]
            hashes = [phrase_hashes(ids, words, lang, order[starts[inside]], n) for n, (starts, _, inside) in enumerate(found[:2], 1)]
            # the answers stand in the order in which the hashes were asked for
            dealt, asked, edges = _dealt(np.concatenate(hashes), buckets)
            often = np.zeros(len(dealt), dtype=bool)
            for b, i, j in zip(asked.tolist(), edges, edges[1:]):
                often[dealt[i:j]] = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=j - i)
            paired = np.zeros(len(ids) + longest, dtype=bool)
            for n, (starts, sizes, inside) in enumerate(found, 1):
                if n < 3:
                    inside[inside] = often[: len(hashes[0])] if n == 1 else often[len(hashes[0]) :]
                if n == 2:
                    paired[order] = np.repeat(inside, sizes)
                for d in range(n - 1 if n > 2 else 0):
                    inside &= paired[order[starts] + d]
                at = order[starts[inside]]
                parts = [named.take(pa.array(ids[at + d] - 1)) for d in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0]
                turn, to, ends = _dealt(phrase_hashes(ids, words, lang, at, n), buckets)
                texts, sums = phrase.take(pa.array(turn)).to_pylist(), sizes[inside][turn].astype(np.int32)
                rows += [(int(b), lang, zstandard.compress(b"\n".join(texts[i:j])), packed(sums[i:j])) for b, i, j in zip(to, ends, ends[1:])]
        return _table([pa.int64(), pa.string(), pa.binary(), pa.binary()], ["bucket", "lang", "phrases", "counts"], rows)

    return counted


def _merging(least: int):
    def merged(bucket: pa.Table) -> pa.Table:
        """The phrases of a bucket that reach the least count."""
        parts = []
        for k in range(bucket.num_rows):
            texts = zstandard.decompress(bucket["phrases"][k].as_py()).split(b"\n")
            langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(texts), dtype=np.int32)), pa.array([bucket["lang"][k].as_py()])).cast(pa.string())
            parts.append(pa.table([langs, pa.array(texts, pa.binary()), pa.array(unpacked(bucket["counts"][k].as_py()).astype(np.int64))], names=["lang", "phrase", "n"]))
        summed = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        kept = summed.filter(pc.greater_equal(summed["n_sum"], least))
        size = pc.add(pc.count_substring(kept["phrase"], " "), pa.scalar(1, pa.int32()))
        return pa.table([kept["lang"], kept["phrase"].cast(pa.string()), size.cast(pa.int32()), kept["n_sum"]], names=["lang", "phrase", "words", "n"])

    return merged


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n)
    of all words; both stored."""
    if not 2 <= longest <= 100 or not 1 <= least <= 255:
        raise ValueError("phrases have 2 to 100 words and a least count of 1 to 255")
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("text"))
    shards = stored(rows.mapInArrow(_shards, SHARD), "shards").where("n > 0")
    totals = stored(shards.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language")
    buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS
    answers = shards.mapInArrow(_asking(buckets, least), ASKED).groupBy("bucket").applyInArrow(_answering(least), ANSWERED)
    counted = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_counting(longest, least, buckets), COUNTED)
    summed = stored(counted.groupBy("bucket").applyInArrow(_merging(least), MERGED), "phrases")
    discard(shards)
    release(docs.sparkSession)
    return summed, totals


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of the phrases of two words and more: the cut of the lowest score, of
    those the shortest first part."""
    ws = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), ws.alias("ws"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda first, size: F.array_join(F.slice("ws", first, size), " ")
    cut = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    one = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    both = one.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    # products of counts below 10^16 and the factor fit 38 digits; div is exact
    score = F.expr(f"CAST(CAST({wide('a')} * {wide('a')} AS DECIMAL(31,0)) * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div CAST({wide('l')} * {wide('r')} AS DECIMAL(38,0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, longest: int = LONGEST, covered: int = COVERED) -> DataFrame:
    """``candidates`` without those that stand in a longer one with ``covered`` per cent of their count."""
    if longest < 3:
        return candidates
    ws, size = F.split("phrase", " "), F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(positions(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " "))))
    within = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    joined = candidates.join(within, ["lang", "phrase"], "left")
    return joined.where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a"))).drop("_longer")


def ranked(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score and count, both descending, and phrase, with their rank: first
    within parts of a language, then over what the parts leave."""
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = candidates.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranks = first.drop("_part", "_rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranks.where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language.

    a counts the phrase, l and r the parts of its lowest-scoring cut, n all words of the language; the score is
    floor(10^6 a^2 / (l r)).
    """
    counts, totals = phrase_counts(docs, longest, least)
    best = ranked(uncovered(scored(counts), longest, covered), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
