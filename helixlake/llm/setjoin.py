"""N-gram Jaccard join by set relations: documents whose sets of word n-grams are similar, and their components.

Documents of one set are one node. The index lists of a set's rarest n-grams (as many as two similar sets can't both
miss) hold the place of the n-gram in the order of rarity, which skips what can't be similar: n-grams before the first
common one are missing in the other set, so that the places of a pair add up to no more than the difference that it
may have. Lists are cut into blocks of similar sizes; a set meets its own block and the next.

The member of the least place leads its list, as the set that has the fewest rarer n-grams than those they share. Every
member's answer for its leaders is computed first: size of the intersection, and what either set has that the other
lacks. Later pairs under one leader are skipped if their answers put them too far apart (the distance is a metric), or
derived from the two differences; whole sets are compared only where there is no common leader. Lists whose members
are in one component are over; the others meet growing numbers of their members, in the end all.

Rarity is counted for the n-grams of the lowest ``COUNTED`` share of hashes, which come first; the rest follow by hash.
The order is the same for all sets, so that nothing is lost by it; one that few sets share is cheap.

N-grams are compared by 64-bit hashes of their words. Defined results: a null or empty text has an empty set, which is
linked with nothing; a text of fewer words than an n-gram has its whole sequence as one; rows of equal sets are linked;
a null id never names a component, one of null ids alone is null; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm.common import discard, release, stored
from helixlake.llm.components import components

NGRAM, PERCENT = 3, 90
#: Share of the hashes whose n-grams are counted; the index needs a tenth of a set's n-grams at 90 per cent.
COUNTED = 0.15
#: Words of 64 bits in the parity map of a set: bits that differ between two maps are n-grams that one set lacks.
MAP = 16
#: Leaders that a set is compared with first, those of most of its lists.
FIRST = 2
#: Members of a list that the others meet in the second round; each later round has so many times more.
GROWTH = 64
#: Up to so many sets (16 bytes each) are named to the scan by broadcast; more are joined by shuffle.
BROADCAST_SETS = 1_000_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

FEATURES = T.StructType(
    [
        T.StructField("node", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("counted", T.IntegerType()),
        T.StructField("low", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType())),
    ]
)
ANSWER = T.StructType([T.StructField("overlap", T.LongType()), T.StructField("minus", T.BinaryType()), T.StructField("plus", T.BinaryType())])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ngrams(text: bytes, known: dict[bytes, int], n: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams."""
    words = text.translate(_LOWER).split()  # at the six blanks of ASCII alone
    hashed = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1 if k else 0, k, dtype=np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashed[j : j + len(out)]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return np.unique(out ^ (out >> np.uint64(33)))


def parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount(((tokens >> np.uint64(17)) % np.uint64(64 * MAP)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefix(n: Column | int, percent: int) -> Column | int:
    """How many n-grams, of any order that all sets share, two similar sets can't both lack."""
    return (n * (100 - percent) - n * (100 - percent) % 100) / 100 + 1 if isinstance(n, Column) else n * (100 - percent) // 100 + 1


def _features(n: int, percent: int):
    border = np.uint64(int(COUNTED * 2**64))

    @F.pandas_udf(FEATURES)
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for text in batch:
                tokens = ngrams(bytes(text), known, n)
                counted = int(np.searchsorted(tokens, border))
                low = tokens[: max(counted, _prefix(len(tokens), percent))]
                rows.append((xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), counted, low.view(np.int64), parity(tokens)))
            yield pd.DataFrame(rows, columns=FEATURES.names)

    return features


def _sets(n: int):
    @F.pandas_udf(T.BinaryType())
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Hashes()
        for batch in batches:
            yield pd.Series([ngrams(bytes(text), known, n).tobytes() for text in batch], dtype=object)

    return sets


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each element of sorted distinct a, whether sorted distinct b has it."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _views(column: pa.Array) -> list[np.ndarray]:
    """The hashes of each value of a binary column, where they lie."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return [flat[i:j].view(np.uint64) for i, j in zip(offsets, offsets[1:])]


def _answers(percent: int):
    @F.arrow_udf(ANSWER)
    def answers(left: pa.Array, right: pa.Array) -> pa.Array:
        overlaps, minus, plus = [], [], []
        for a, b in zip(_views(left), _views(right)):
            held = common(a, b)
            overlap = int(held.sum())
            # what is twice as far apart as a link may be tells nothing of others
            near = (100 + percent) * (len(a) + len(b) - 2 * overlap) <= 2 * (100 - percent) * (len(a) + len(b))
            overlaps.append(overlap)
            minus.append(a[~held].tobytes() if near else None)
            plus.append(b[~common(b, a)].tobytes() if near else None)
        return pa.StructArray.from_arrays([pa.array(overlaps, pa.int64()), pa.array(minus, pa.binary()), pa.array(plus, pa.binary())], names=ANSWER.names)

    return answers


@F.arrow_udf(T.LongType())
def derived(size: pa.Array, minus_a: pa.Array, plus_a: pa.Array, minus_b: pa.Array, plus_b: pa.Array) -> pa.Array:
    """Size of the intersection of a and b by what each lacks and has beside one leader of ``size``."""
    parts = map(_views, (minus_a, plus_a, minus_b, plus_b))
    out = [n - len(ma) - len(mb) + int(common(ma, mb).sum()) + int(common(pa_, pb).sum()) for n, ma, pa_, mb, pb in zip(size.to_pylist(), *parts)]
    return pa.array(out, pa.int64())


def _linked(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n + m - overlap)


def _near(difference: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m may link that differ in so many n-grams."""
    return (100 + percent) * difference <= (100 - percent) * (n + m)


def _fitting(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sizes allow a link, and the places i and j of the first n-gram that the sets share."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _near(i + j, n, m, percent)


def _possible(x: str, y: str, percent: int) -> Column:
    alone = sum(F.bit_count(F.get(f"{x}.bits", F.lit(k)).bitwiseXOR(F.get(f"{y}.bits", F.lit(k)))) for k in range(MAP))
    return _near(alone, F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, own, id, n, pos): what the index lists hold, of sets that may link with another.

    A list is of an n-gram and a block of sizes, ``own``, and of the next block; two sets of that one meet in its list.
    """
    large = nodes.where(percent <= (100 - percent) * F.col("n"))  # of fewer n-grams, one that differs is too many
    tokens = large.select("id", F.explode(F.slice("low", 1, F.col("counted"))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("often"))
    p = _prefix(F.col("n"), percent).cast("int")
    rest = F.slice("low", F.col("counted") + 1, F.greatest(p - F.col("counted"), F.lit(0)))
    joined = large.select("id", "n", "counted", p.alias("p"), rest.alias("rest")).join(own, "id", "left")
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    often = F.coalesce("often", none)
    single = F.col("counted") - F.size(often)
    placed = F.transform(F.slice(often, 1, F.greatest(F.col("p") - single, F.lit(0))), lambda t, k: F.struct(t["token"].alias("token"), (single + k).cast("int").alias("pos")))
    after = F.transform("rest", lambda t, k: F.struct(t.alias("token"), (F.col("counted") + k).cast("int").alias("pos")))
    entries = joined.select("id", "n", F.inline(F.concat(placed, after)))
    # a little more than the ratio that two linked sizes can have, so that rounding parts none
    block = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.0001))
    own, below = ((F.struct(F.xxhash64("token", b).alias("key"), F.lit(own).alias("own"))) for b, own in ((block, True), (block - 1, False)))
    return entries.select("id", "n", "pos", F.inline(F.array(own, below)))


def links(nodes: DataFrame, docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(id, root) of each node that is linked with another, by component.

    ``nodes``: id, n, counted, low, bits and ``copy``, the digest of a text that has the set; ``docs``: copy and text.
    """
    maps = nodes.select("id", F.struct("n", "bits").alias("s"))
    members = stored(_lists(nodes, percent), "entries")
    lists = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("pos", "id", "n")).alias("lead")).where("size > 1")
    shared = stored(members.join(lists, "key"), "members")
    discard(members)

    def with_sets(pairs: DataFrame) -> DataFrame:
        """(a, b, n, m, answer) of the pairs, from their whole sets."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = stored(ids.join(nodes.select("id", "copy", "n"), "id"), "nodes")
        named = wanted.select("copy")
        once = docs.join(F.broadcast(named) if wanted.count() <= BROADCAST_SETS else named, "copy", "left_semi").groupBy("copy").agg(F.min("text").alias("text"))
        sets = stored(wanted.join(once, "copy").select("id", "n", _sets(ngram)("text").alias("tokens")), "sets")
        left = pairs.join(sets.select(F.col("id").alias("a"), "n", F.col("tokens").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")), "b")
        found = stored(both.select("a", "b", "n", "m", _answers(percent)("x", "y").alias("answer")), "answers")
        for old in (wanted, sets):
            discard(old)
        return found

    lead = F.col("lead")
    met = shared.where((lead["id"] != F.col("id")) & _fitting(F.col("n"), lead["n"], F.col("pos"), lead["pos"], percent))
    tally = met.groupBy("id", lead["id"].alias("lead")).agg(F.count("*").alias("c"))
    few = tally.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "lead")), False), 1, FIRST).alias("leads"))
    star = few.select(F.explode("leads.lead").alias("a"), F.col("id").alias("b"))
    mapped = star.join(maps.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(maps.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    pairs = stored(mapped.where(_possible("sa", "sb", percent)).select("a", "b"), "pairs")
    computed = with_sets(pairs)
    discard(pairs)
    linked = _linked(F.col("answer.overlap"), F.col("n"), F.col("m"), percent)
    roots = components(computed.where(linked).select("a", "b"))
    nearest = computed.where("answer.minus IS NOT NULL").groupBy("b").agg(F.max_by(F.struct("a", "n", "answer"), F.col("answer.overlap") / (F.col("n") + F.col("m"))).alias("l"))
    answers = stored(nearest.select(F.col("b").alias("id"), F.col("l.a").alias("leader"), F.col("l.n").alias("size"), "l.answer.*"), "nearest")

    def under_leader(side: str) -> DataFrame:
        return answers.select(F.col("id").alias(side), F.struct("leader", "size", "overlap", "minus", "plus").alias(f"l{side}"))

    def distance(answer: str, n: str) -> Column:
        return 1 - F.col(f"{answer}.overlap") / (F.col(n) + F.col(f"{answer}.size") - F.col(f"{answer}.overlap"))

    most, b = shared.agg(F.max("size")).first()[0] or 0, 1
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while b < most:
        before, b = b, b * GROWTH
        known = shared.where(F.col("size") > before).select("key", "own", "id", "pos", "size", draw.alias("draw")).join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        split = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        fresh = F.col("draw") * F.col("size") >= (before if before > 1 else 0)
        open_ = stored(known.where(fresh).join(split, "key", "left_semi").join(maps, "id"), "open-members")
        if open_.isEmpty():
            discard(open_)
            continue
        side = lambda t: [F.col("key").alias(f"k{t}"), *[F.col(c).alias(f"{c}_{t}") for c in ("id", "own", "pos", "draw", "root", "s")]]
        x, y = open_.where(F.col("draw") * F.col("size") < b).select(*side("x")), open_.select(*side("y"))
        unmet = (F.col("own_x") | F.col("own_y")) & (F.col("root_x") != F.col("root_y")) & ((F.col("draw_x") < F.col("draw_y")) | (F.col("draw_x") == F.col("draw_y")) & (F.col("id_x") < F.col("id_y")))
        fits = _fitting(F.col("s_x.n"), F.col("s_y.n"), F.col("pos_x"), F.col("pos_y"), percent) & _possible("s_x", "s_y", percent)
        met = x.join(y, (F.col("kx") == F.col("ky")) & unmet & fits)
        one, two = F.struct(F.col("id_x").alias("id"), F.col("s_x.n").alias("n")), F.struct(F.col("id_y").alias("id"), F.col("s_y.n").alias("n"))
        pairs = met.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q")).distinct()
        pairs = pairs.select(F.col("p.id").alias("a"), F.col("p.n").alias("n"), F.col("q.id").alias("b"), F.col("q.n").alias("m"))
        judged = pairs.join(under_leader("a"), "a", "left").join(under_leader("b"), "b", "left")
        unknown = ~F.coalesce(F.col("la.leader") == F.col("b"), F.lit(False)) & ~F.coalesce(F.col("lb.leader") == F.col("a"), F.lit(False))
        same = F.coalesce(F.col("la.leader") == F.col("lb.leader"), F.lit(False))
        # by the triangle inequality; the margin is for rounding only
        reach = F.abs(distance("la", "n") - distance("lb", "m")) <= (1 - percent / 100) + 1e-9
        judged = stored(judged.where(unknown).withColumn("same", same).where(~F.col("same") | reach), "candidates")
        discard(open_)
        by_leader = judged.where("same").select("a", "b", "n", "m", derived("la.size", "la.minus", "la.plus", "lb.minus", "lb.plus").alias("overlap"))
        more = by_leader.where(_linked(F.col("overlap"), F.col("n"), F.col("m"), percent)).select("a", "b")
        apart = judged.where("NOT same").select("a", "b")
        if not apart.isEmpty():
            more = more.unionByName(with_sets(apart).where(linked).select("a", "b"))
        more = stored(more, "links")
        discard(judged)
        if not more.isEmpty():
            old = roots
            roots = components(more.unionByName(old.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            discard(old)
    for old in (shared, computed, answers):
        discard(old)
    return roots.select(F.col("node").alias("id"), "root")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (the least id reachable by links) of each row."""
    if not 1 <= percent <= 99 or ngram < 1:
        raise ValueError("the least similarity is 1 to 99 per cent, of n-grams of at least a word")
    value = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[doc_id].alias("doc_id"), F.unhex(F.md5(value)).alias("copy"), value.alias("text"))
    base = stored(rows.select("doc_id", "copy", _features(ngram, percent)(F.col("text").cast("binary")).alias("f")).select("doc_id", "copy", "f.*"), "features")
    kept = base.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("copy", "n", "counted", "low", "bits")])
    nodes = stored(kept.withColumn("id", F.monotonically_increasing_id()), "sets-by-node")  # ids stay as they are stored
    roots = links(nodes, rows.select("copy", F.col("text").cast("binary").alias("text")), ngram, percent)
    named = nodes.select("id", "node").join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    placed = base.where("n > 0").select("doc_id", "node", "n").join(named, "node").select("doc_id", "n", "root")
    placed = stored(placed, "placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    size = F.col("n").cast("long").alias("n_shingles")
    out = placed.join(least, "root").select("doc_id", size, "component_id")
    none = stored(base.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id")), "without-words")
    for old in (base, nodes):
        discard(old)
    release(docs.sparkSession)
    return out.unionByName(none)
