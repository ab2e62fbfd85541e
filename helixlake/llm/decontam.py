"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words of which a fixed mask ignores some. Seeds of the benchmark and of the
documents are joined by hash; around every hit the two texts are laid side by side, without gaps,
and the overlap is verified: in some ``WINDOW`` words in a row all but ``MISMATCHES`` agree. With the
mask used, every such overlap holds a hit (the tests try all placements), so nothing is lost. Items
shorter than the window have to agree in full; those shorter than a mask are hashed whole.
Built-in functions only.

Defined results: one row per document id and item; items of equal words count as the one with the
smallest id (null last); null or wordless texts match nothing; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import let, positions, stored, texts
from helixlake.llm.licenses import words

WINDOW, MISMATCHES = 13, 2
#: Offsets of the words that a mask looks at.
MASKS = ((0, 1, 3, 6, 7),)
#: Up to so many seeds (24 bytes each) are broadcast, and a bit table of them (64 bits for each) lets rows be
#: made for likely hits only; those of a larger benchmark are joined by shuffle.
BROADCAST_SEEDS = 50_000
#: Up to so many words of items, or texts with hits, are broadcast.
BROADCAST_WORDS, BROADCAST_TEXTS = 1_000_000, 500_000


def span(mask: tuple[int, ...]) -> int:
    return mask[-1] + 1


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, iw (words) of the distinct items."""
    read = benchmark.select(F.col(item_id).alias("item_id"), words(texts(benchmark, text)).alias("iw")).where(F.size("iw") > 0)
    return read.groupBy("iw").agg(F.min("item_id").alias("item_id"))


def _shapes(lengths: list[int], masks) -> list[tuple[int, tuple[int, ...], int | None]]:
    """(tag, offsets, item length or None): the masks, and whole items of each length too short for them."""
    least = max(map(span, masks))
    whole = [(-n, tuple(range(n)), n) for n in lengths if n < least]
    return [(k, mask, None) for k, mask in enumerate(masks)] + whole


def _seeds(ws: Column, shapes, of_items: bool) -> Column:
    """array<struct<at, seed>> of a list of words. Shapes of one length take items of it only."""

    def of_shape(tag: int, offsets: tuple[int, ...], length: int | None) -> Column:
        made = F.transform(
            positions(F.lit(0), F.size(ws) - span(offsets)),
            lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(tag), *[F.get(ws, i + k) for k in offsets]).alias("seed")),
        )
        return F.filter(made, lambda _: F.size(ws) == length) if of_items and length else made

    return F.concat(*[of_shape(*shape) for shape in shapes])


def _overlap(ws: Column, iw: Column, diagonal: Column) -> Column:
    """struct<matched, first> of the words side by side, matched null if no window of them agrees enough."""
    start, stop = F.greatest(F.lit(0), -diagonal), F.least(F.size(iw), F.size(ws) - diagonal)
    agree = F.transform(positions(start, stop - 1), lambda i: (F.get(ws, i + diagonal) == F.get(iw, i)).cast("int"))

    def judged(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0), lambda n, x: n + x)
        best = F.array_max(
            F.transform(positions(F.lit(1), F.size(a) - WINDOW + 1), lambda p: F.aggregate(F.slice(a, p, WINDOW), F.lit(0), lambda n, x: n + x))
        )
        enough = F.when(F.size(iw) < WINDOW, total == F.size(iw)).otherwise(best >= WINDOW - MISMATCHES)
        return F.struct(F.when(enough, total.cast("long")).alias("matched"), (start + diagonal).cast("long").alias("first"))

    return let(agree, judged)


def _probes(size: int) -> tuple[int, int]:
    """Shifts that take two places of a table of ``size`` bits (a power of two) from a hash."""
    return 0, 63 - size.bit_length()


def bit_table(seeds: list[int]) -> tuple[str, int]:
    """A JSON list of 64-bit words with two bits set for each seed, and its number of bits."""
    size = 1 << max(10, (64 * len(seeds)).bit_length())
    words_ = [0] * (size // 64)
    for s in seeds:
        for shift in _probes(size):
            at = (s & (1 << 64) - 1) >> shift & size - 1
            words_[at // 64] |= 1 << at % 64
    return str([w - (1 << 64) if w >> 63 else w for w in words_]), size


def _likely(seed: Column, seeds: list[int]) -> Column:
    """Whether a seed may be among ``seeds``."""
    table, size = bit_table(seeds)
    bits, found = F.from_json(F.lit(table), "array<bigint>"), F.lit(True)
    for shift in _probes(size):
        at = F.shiftrightunsigned(seed, shift).bitwiseAND(F.lit(size - 1))
        word = F.get(bits, F.shiftrightunsigned(at, 6).cast("int"))
        found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return found


def _diagonals(keyed: DataFrame, seeds: DataFrame, shapes, most: int) -> DataFrame:
    """(key, item_id, diagonal): the ways to lay texts and items side by side that seeds ask for, each once."""
    of_text = let(words(F.col("text")), lambda ws: _seeds(ws, shapes, False))
    rows = [r["seed"] for r in seeds.select("seed").limit(most + 1).collect()]
    if len(rows) <= most:
        known = sorted(set(rows))
        of_text, seeds = F.filter(of_text, lambda s: _likely(s["seed"], known)), F.broadcast(seeds)
    # the outer form, as the plain one has its input computed twice, to filter out what is empty
    bare = keyed.select("key", F.explode_outer(of_text).alias("s")).where("s IS NOT NULL").select("key", "s.at", "s.seed")
    return bare.join(seeds, "seed").select("key", "item_id", (F.col("at") - F.col("iat")).alias("diagonal")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, doc_id: str = "doc_id", text: str = "text", most: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, n_item_words, n_matched (on the best diagonal), first_word of every overlap.

    Hits are bare numbers until the diagonals are distinct; then the texts that have any are read again, and
    each diagonal gets the words that its item lies beside.
    """
    items = items_of(benchmark).select("item_id", "iw", F.size("iw").alias("n"))
    total, least = items.agg(F.sum("n"), F.collect_set(F.when(F.col("n") < max(map(span, masks)), F.col("n")))).first()
    shapes = _shapes(sorted(least), masks)
    seeds = items.select("item_id", F.explode(_seeds(F.col("iw"), shapes, True)).alias("s")).select("item_id", F.col("s.at").alias("iat"), "s.seed")
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), texts(docs, text).alias("text")).withColumn("key", key)
    met = _diagonals(keyed, seeds, shapes, most)
    sized = met.join(items.select("item_id", "n"), met["item_id"].eqNullSafe(items["item_id"])).select("key", F.struct(met["item_id"], "diagonal", "n").alias("d"))
    asked = stored(sized.groupBy("key").agg(F.collect_list("d").alias("ds")), "diagonals")
    few = F.broadcast(asked) if (asked.agg(F.sum(F.size("ds"))).first()[0] or 0) <= BROADCAST_TEXTS else asked
    texts_asked = keyed.join(few.withColumnRenamed("key", "asked"), F.col("key") == F.col("asked")).dropDuplicates(["key"])

    def beside(ws: Column) -> Column:
        """Each item's place, and the words from there on."""
        return F.transform(
            "ds", lambda d: F.struct(d.alias("d"), F.slice(ws, F.greatest(d["diagonal"], F.lit(0)) + 1, d["n"]).alias("window"))
        )

    laid = texts_asked.select("doc_id", F.explode(let(words(F.col("text")), beside)).alias("w")).select("doc_id", "w.d.item_id", "w.d.n", "w.d.diagonal", "w.window")
    all_items = items.select(F.col("item_id").alias("id"), "iw")
    both = laid.join(F.broadcast(all_items) if (total or 0) <= BROADCAST_WORDS else all_items, laid["item_id"].eqNullSafe(F.col("id")))
    left = F.greatest(F.col("diagonal"), F.lit(0))
    judged = both.select("doc_id", "item_id", "n", left.alias("left"), _overlap(F.col("window"), F.col("iw"), F.col("diagonal") - left).alias("o"))
    return judged.where("o.matched IS NOT NULL").groupBy("doc_id", "item_id").agg(
        F.max("n").cast("long").alias("n_item_words"), F.max("o.matched").alias("n_matched"), F.min(F.col("o.first") + F.col("left")).alias("first_word")
    )


def without_overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage: all rows of their id, but of a null id
    each text is judged by itself."""
    copy = F.when(docs["doc_id"].isNull(), F.unhex(F.md5(docs["text"].cast("string"))))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.struct(docs["doc_id"].alias("id"), copy.alias("copy")).alias("doc_id"), docs["text"])
    found = overlaps(whole, benchmark, masks).select(F.col("doc_id.id").alias("id"), F.col("doc_id.copy").alias("copy")).distinct()
    found = stored(found, "leaks")
    few = F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found
    left = whole.join(few, F.col("doc_id.id").eqNullSafe(found["id"]) & F.col("doc_id.copy").eqNullSafe(found["copy"]), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
