"""Line dedup by an exact set-similarity join.

A line is the set of its words; a line goes if an earlier one, by (document id, MD5 of the text, line number), has a
Jaccard similarity of 0.8 or more to it, kept or not. Equal lines are one class. The words of a set
are ordered by rarity (frequency in the corpus, counted over all lines in a table of fixed size, then
by hash).

Prefix filter. A single rare word of a large corpus still stands in very many lines, so the prefix is made of
grams: two neighbours in the order of rarity, or three where two are too frequent to tell lines apart. A
word that one set lacks breaks the grams around it only, so similar sets share a gram among their first
ones (``_places`` has the bound). Length filter: like sizes. Positional filter: from where
the grams stand the overlap can still be reached. What is left is verified on the whole sets.

Every line needs one earlier match only. Lines of a gram's bucket first meet its earliest line, then its first few,
as a family of near copies has a match there; those that nothing settles meet all earlier lines of it, in a join that
verifies on the spot and stops at the first match: it gives no more rows than open lines have grams.
Built-in functions only.

Defined results: a null text has no lines; lines without words are never removed; rows that repeat an
id and text count as one and share their fate, other texts of that id are their own; null ids sort first. Words are
held as hashes: of 44 bits for order, of 30 for candidates, and of 64 bits in the verification.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import discard, let, release, stored, texts

SPACES = r"[\x20\x09-\x0D]+"
#: Places of the frequency table; it is counted by Spark and handed to the rows as one literal.
TABLE = 1 << 17
#: Words of a line that the choice of a gram's length reckons with, and lines that may share one by chance.
#: Both decide the cost only.
NOMINAL_LINE, BY_CHANCE = 32, 1 / 8
#: Sets of up to so many words have grams of two words only: three need longer sets to survive an edit.
#: Those that may be similar to a larger set have both kinds.
SHORT = 12
#: Grams that similar sets of more than SHORT words have in common at least, as so many are shown beyond the first.
SHARED = 3
#: Earliest lines of a bucket that open lines meet before they meet all.
FIRST = 16
#: Sets of up to so many words travel with the grams of open lines in buckets of more than FIRST, 8 bytes a word;
#: a larger one would travel too often.
HELD = 128
#: Up to so many lines (24 bytes each) are named to a scan by broadcast; more are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: Shares of the grams' keys that are dealt one after the other: no more of them is on disk at once than one share.
PASSES = 5

INTS = "array<int>"
HASH_BITS = 44


def _words(line: Column) -> Column:
    """Words of a line; blanks alone need no regex."""
    split = F.when(F.rlike(line, F.lit(r"[\x09\x0B-\x0D]")), F.split(line, SPACES)).otherwise(F.split(line, " "))
    return F.array_remove(split, "")


def copy_of(docs: DataFrame, text: str = "text") -> Column:
    """What tells a text from others of its id."""
    return F.unhex(F.md5(docs[text].cast("string")))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, copy (MD5 of the text), line_no, line of every line with a word."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), copy_of(docs, text).alias("copy"), F.split(texts(docs, text), "\n").alias("lines"))
    # the outer form, as the plain one has its input computed twice, to filter out what is empty
    flat = rows.select("doc_id", "copy", F.posexplode_outer("lines").alias("line_no", "line"))
    return flat.where(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]")))


def rarity(lines: DataFrame) -> tuple[str, int]:
    """Quarter-octave frequencies of the words of all ``lines`` by hash, as a JSON list of TABLE small numbers (it stands in
    plans, which the driver keeps); and the greatest rank sum of two words that make a gram."""
    words = lines.select(F.explode_outer(_words(F.col("line"))).alias("w"))
    placed = words.select(F.xxhash64("w").bitwiseAND(F.lit(TABLE - 1)).cast("int").alias("at"))
    counted = placed.groupBy("at").agg(F.count("*").alias("n")).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n")).first()
    ranks = [0] * TABLE
    for at, n in zip(counted["at"], counted["n"]):
        ranks[at] = min(127, math.floor(4 * math.log2(n)))
    n = max(1, sum(counted["n"]) // NOMINAL_LINE)
    return "[" + ",".join(map(str, ranks)) + "]", math.floor(4 * math.log2(max(1, n * BY_CHANCE)))


def ordered(line: Column, table: str) -> Column:
    """The set of a line's words, rarest first: 7 bits of frequency, 44 of hash."""
    ranks = F.from_json(F.lit(table), "array<tinyint>")

    def key(h: Column) -> Column:
        # never null, so that the arrays are sorted as plain numbers
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(TABLE - 1)).cast("int")), F.lit(0).cast("tinyint"))
        return F.shiftleft(rank.cast("bigint"), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))

    return F.sort_array(F.transform(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), key))


class Places:
    """Places of lines, (document id, copy, line number), as numbers in the same order.

    Ids that have one text each are packed with the line number; else their texts are numbered.
    """

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        value = docs[text].cast("string")
        each = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(value).alias("h"), F.octet_length(value).alias("size"))
        ids = each.groupBy("doc_id").agg(F.max("size").alias("size"), (F.min("h") != F.max("h")).alias("several"))
        least, most, size, several = ids.agg(F.min("doc_id"), F.max("doc_id"), F.max("size"), F.coalesce(F.max("several"), F.lit(False))).first()
        self.shift = max(1, (size or 0).bit_length())  # a text has fewer lines than bytes and one
        self.least = least
        self.dense = None
        whole = dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint")
        packed = whole and (least is None or (most - least + 2).bit_length() + self.shift <= 62)
        if not packed or several:
            held = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), copy_of(docs, text).alias("copy"))
            self.dense = self._numbered(held.distinct())

    @staticmethod
    def _numbered(ids: DataFrame) -> DataFrame:
        """(doc_id, copy, no): texts of ids that can't be packed, numbered in order."""
        rough = stored(ids.orderBy("doc_id", "copy").withColumn("no", F.monotonically_increasing_id()), "ids")
        part = F.shiftrightunsigned("no", 33)
        counts, start, before = dict(rough.groupBy(part.alias("p")).count().collect()), {}, 0
        for p in sorted(counts):
            start[p], before = before, before + counts[p]
        offsets = F.from_json(F.lit("[" + ",".join(str(start.get(p, 0)) for p in range(max(start, default=0) + 1)) + "]"), "array<bigint>")
        return rough.select("doc_id", "copy", (F.get(offsets, part.cast("int")) + F.col("no").bitwiseAND(F.lit((1 << 33) - 1))).alias("no"))

    def of(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``place``."""
        if self.dense is not None:
            numbers = self.dense.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "no")
            joined = lines.join(numbers, lines["doc_id"].eqNullSafe(F.col("_id")) & (lines["copy"] == F.col("_copy")), "left")
            return joined.withColumn("place", self._packed(F.col("no") + 1)).drop("no", "_id", "_copy")
        return lines.withColumn("place", self._packed(F.col("doc_id").cast("bigint") - F.lit(self.least) + 1))

    def _packed(self, number: Column) -> Column:
        return F.shiftleft(F.coalesce(number, F.lit(0).cast("bigint")), self.shift).bitwiseOR(F.col("line_no").cast("bigint"))


def _identity() -> list[Column]:
    return [F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")]


def _rank(key: Column) -> Column:
    return F.shiftrightunsigned(key, HASH_BITS)


def _lacking(n: Column) -> Column:
    """Words of a set of n that a similar one lacks, at most."""
    return F.floor(n / 5).cast("int")


def _places(n: Column, keys: Column, most: int) -> tuple[Column, Column]:
    """How many grams of two words, and of two or three, a set of ``n`` words shows.

    Where x lacks no more than ``a`` words of y and y no more than ``b`` of x, the similarity of 4/5 has
    a <= n / 5 and a + b <= (n - a) / 4. To break all grams of length g at the first places, every g of them
    take a word that y lacks, or every g - 1 a word that only y has, put between: so a + (g - 1) (n - a) / 4
    places can be broken, most of them where a is greatest, and those after them can't. Grams of two words, which
    come first as ranks only rise, are broken by twos: half a place less for each of them.
    """
    a = _lacking(n)
    two = F.least(n - 1, a + F.floor((n - a) / 4).cast("int") + 1)
    short = F.when(n == 1, F.lit(1)).when(n <= SHORT, two).otherwise(F.lit(0))

    def enough(end: Column) -> Column:
        """Whether the gram before place ``end`` has two words, and so all before it."""
        return _rank(F.get(keys, end - 1)) + _rank(F.get(keys, end)) <= most

    def adaptive(bound: Column) -> Column:
        parts = [F.floor(bound * k / 4).cast("int") for k in (3, 2, 1)]
        pairs = F.when(enough(bound), bound)
        for part in parts:  # fewer than there are do no harm
            pairs = pairs.when((part > 0) & enough(F.greatest(part, F.lit(1))), part)
        three = a + F.floor((n - a) / 2).cast("int") + SHARED
        return let(pairs.otherwise(F.lit(0)), lambda r: F.when(r == bound, bound).otherwise(F.least(n - 2, three - F.floor(r / 2).cast("int"))))

    more = F.least(n - 2, two + SHARED - 1)
    return short, F.when(n >= F.lit(math.ceil((SHORT + 1) * 4 / 5)), let(more, adaptive)).otherwise(F.lit(0))


def several(lines: DataFrame) -> DataFrame:
    """a, b (hash of the line), first (its earliest place) of the lines that stand in several places."""
    counted = lines.select("place", *_identity()).groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return stored(counted.where("first < last").drop("last"), "line-firsts")


def firsts(lines: DataFrame, again: DataFrame) -> DataFrame:
    """place, line: each line text once, where it stands first."""
    few = F.broadcast(again) if again.count() <= BROADCAST_LINES else again
    return lines.select("place", "line", *_identity()).join(few, ["a", "b"], "left").where("first IS NULL OR place = first").select("place", "line")


def shown(lines: DataFrame, table: str, most: int) -> DataFrame:
    """place, n (words), short and long (numbers of grams), keys (the rarest words) of each line.

    A key here is 30 bits of the word's hash above a bit that says whether a gram that begins there takes three words: lines
    are stored so, and a word that shares its bits with another makes candidates that the verification drops.
    """

    def of_keys(keys: Column) -> Column:
        n = F.size(keys)
        short, long_ = _places(n, keys, most)

        def held(key: Column, i: Column) -> Column:
            three = _rank(key) + _rank(F.get(keys, i + 1)) > most
            return key.bitwiseAND(F.lit(0x7FFFFFFE)).cast("int").bitwiseOR(F.when(three, 1).otherwise(0))

        return let(
            F.struct(short.alias("short"), long_.alias("long")),
            lambda s: F.struct(n.alias("n"), s["short"].alias("short"), s["long"].alias("long"), F.transform(F.slice(keys, 1, F.greatest(s["short"] + 1, s["long"] + 2)), held).alias("keys")),
        )

    return lines.select("place", let(ordered(F.col("line"), table), of_keys).alias("s")).select("place", "s.*")


def grams(lines: DataFrame) -> DataFrame:
    """(key, id, ni): the grams that stand for each line, with the number of its words and the gram's place."""
    spread = lines.select("place", "n", "short", "keys", F.explode(F.sequence(F.lit(0), F.col("short") + F.col("long") - 1)).alias("k"))
    i = F.when(F.col("k") < F.col("short"), F.col("k")).otherwise(F.col("k") - F.col("short"))
    x, y, z = (F.shiftright(F.get("keys", i + j), 1) for j in range(3))
    third = F.when((F.col("k") >= F.col("short")) & (F.get("keys", i).bitwiseAND(F.lit(1)) == 1), z)
    ni = F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(i.cast("bigint"))
    return spread.select(F.xxhash64((F.col("k") < F.col("short")), x, y, third).alias("key"), F.col("place").alias("id"), ni.alias("ni"))


def _alike(xni: Column, yni: Column) -> Column:
    """The length and positional filters for two lines of one gram, in integers: a Jaccard similarity of
    4/5 takes an overlap of 4/9 of both sizes together, and the sets share no more than what the shorter
    stretches before and after the gram's first word hold, and that word."""
    nx, ny = F.shiftright(xni, 32), F.shiftright(yni, 32)
    ix, iy = xni.bitwiseAND(F.lit(0xFFFFFFFF)), yni.bitwiseAND(F.lit(0xFFFFFFFF))
    reach = F.least(ix, iy) + F.least(nx - ix, ny - iy)
    return (5 * F.least(nx, ny) >= 4 * F.greatest(nx, ny)) & (9 * reach >= 4 * (nx + ny))


def _need(ni: Column) -> Column:
    """Grams that a line shares with any similar one, at least."""
    return F.when(F.shiftright(ni, 32) > SHORT, SHARED).otherwise(1)


def _buckets(rows: DataFrame) -> DataFrame:
    """key, id, ni, rank, size, lead, lead_ni: the rows of buckets of two lines or more that the filters leave, with
    their rank by place, the rows and the earliest line of the bucket."""
    bucket = Window.partitionBy("key").orderBy("id")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.withColumns(
        {"rank": F.row_number().over(bucket), "size": F.count("*").over(whole), "lead": F.first("id").over(whole), "lead_ni": F.first("ni").over(whole), "last_ni": F.last("ni").over(whole)}
    )
    kept = ranked.where((F.col("size") > 2) | (F.col("size") == 2) & _alike(F.col("lead_ni"), F.col("last_ni")))
    return kept.drop("last_ni")


def _met(rows: DataFrame) -> DataFrame:
    """``_buckets`` of all ``rows``, one share of the keys after the other; of lines with enough such rows."""
    parts = []
    for k in range(PASSES):
        parts.append(stored(_buckets(rows.where(F.pmod("key", F.lit(PASSES)) == k)), "line-buckets"))
        release(rows.sparkSession)
    kept = reduce(DataFrame.unionByName, parts)
    counted = kept.groupBy("id").agg(F.count("*").alias("c"), F.max("ni").alias("ni")).where(F.col("c") >= _need(F.col("ni")))
    enough = stored(counted.select("id"), "line-places")
    few = F.broadcast(enough) if enough.count() <= BROADCAST_LINES else enough
    found = stored(kept.join(few, "id", "left_semi"), "line-buckets")
    for old in (*parts, enough):
        discard(old)
    return found


def _sets(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """place, a, b, t, m: the sets of words of some lines, and their maps."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_LINES else ids
    named = lines.select("place", "line").join(few, "place", "left_semi").dropDuplicates(["place"])
    tokens = F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    return stored(named.select("place", *_identity(), let(tokens, lambda t: F.struct(t.alias("t"), _map(t).alias("m"))).alias("s")).select("place", "a", "b", "s.*"), "line-sets")


def _map(t: Column) -> Column:
    """Number of words and 256 bits of a set: sets differ in at least as many words as their maps do in bits."""
    one = F.lit(1).cast("bigint")

    def part(k: int) -> Column:
        own = F.filter(t, lambda h: h.bitwiseAND(F.lit(3)) == k)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))))

    return F.struct(F.size(t).alias("n"), *[part(k).alias(f"m{k}") for k in range(4)])


def _near(x: str, y: str) -> Column:
    """Whether two sets may be similar by their maps."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum(F.bit_count(F.col(f"{x}.m{k}").bitwiseXOR(F.col(f"{y}.m{k}"))) for k in range(4))
    return 9 * (total - apart) >= 8 * total


def _same(x: str, y: str) -> Column:
    """Whether two sets are similar: a Jaccard similarity of 4/5, in integers."""
    return 9 * F.size(F.array_intersect(x, y)) >= 4 * (F.size(x) + F.size(y))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x of the pairs (x, y) of places whose lines are similar."""
    pairs = stored(pairs, "line-pairs")
    release(pairs.sparkSession)
    need = pairs.select(F.explode(F.array("x", "y")).alias("place")).distinct()
    few = F.broadcast(need) if need.count() <= BROADCAST_LINES else need
    named = sets.select("place", "t").join(few, "place", "left_semi")
    left = pairs.join(named.select(F.col("place").alias("x"), F.col("t").alias("tx")), "x")
    both = left.join(named.select(F.col("place").alias("y"), F.col("t").alias("ty")), "y")
    found = stored(both.where(_same("tx", "ty")).select("x").distinct(), "similar")
    discard(pairs)
    return found


def _settled(late: DataFrame, earlier: DataFrame, sets: DataFrame, best: bool) -> DataFrame:
    """x: lines of ``late`` (key, id, ni, small, xm, xt) that are similar to an earlier one of ``earlier`` (k, y, yni, ysmall, ym, yt).

    Where both sets travel, a line needs one match, so the join gives each row of ``late`` once at most, however many
    lines of its bucket it is like. The others, of small buckets or of more than HELD words, are looked up in pairs;
    with ``best`` the pair of a line that promises most.
    """
    meet = (F.col("key") == F.col("k")) & (F.col("y") < F.col("id")) & _alike(F.col("ni"), F.col("yni")) & _near("xm", "ym")
    held = late.where("xt IS NOT NULL").join(earlier.where("yt IS NOT NULL"), meet & _same("xt", "yt"), "left_semi")
    found = stored(held.select(F.col("id").alias("x")).distinct(), "similar")
    large = HELD * 4 // 5  # of sets that may be similar to one that doesn't travel
    x, y = late.where(F.col("small") | (F.shiftright("ni", 32) > large)), earlier.where(F.col("ysmall") | (F.shiftright("yni", 32) > large))
    none = F.col("xt").isNull() | F.col("yt").isNull()
    near = x.join(found.select(F.col("x").alias("id")), "id", "left_anti").join(y, meet & none)
    shared = near.groupBy(F.col("id").alias("x"), "y").agg(F.count("*").alias("c"), F.max("ni").alias("ni"), F.max("yni").alias("yni"))
    # grams that both sets travelled with are not counted, but then the pair has met on the spot
    enough = shared.where(F.col("c") >= F.least(_need(F.col("ni")), _need(F.col("yni"))))
    return found.unionByName(_similar(enough.groupBy("x").agg(F.max_by("y", "c").alias("y")) if best else enough.select("x", "y"), sets))


def _matched(met: DataFrame, sets: DataFrame) -> DataFrame:
    """x: the places of lines that are similar to an earlier one.

    The earliest lines of the buckets come first, those that promise most; what they leave open meets all that
    the filters and maps allow.
    """
    pair = F.col("id").alias("x"), F.col("lead").alias("y")
    # rows that repeat an id and text stand at one place: no pair
    own = met.where((F.col("lead") < F.col("id")) & _alike(F.col("ni"), F.col("lead_ni"))).groupBy(*pair).agg(F.count("*").alias("c"), F.max("ni").alias("ni"))
    promising = own.where(F.col("c") >= F.least(_need(F.col("ni")), F.lit(2)))
    found = _similar(promising.groupBy("x").agg(F.max_by("y", "c").alias("y")), sets)
    travels = (F.col("size") > FIRST) & (F.size("t") <= HELD)
    small = (F.col("size") <= FIRST).alias("small")
    for upper in (FIRST, None):
        # sets of large buckets travel; those that have met in the first round don't meet again
        t = F.when(travels if upper else travels & (F.col("rank") > FIRST), F.col("t"))
        late = met.where("lead < id").join(found.select(F.col("x").alias("id")), "id", "left_anti").select("key", "id", "ni", "size", "rank")
        late = late.join(sets.select("place", "m", "t"), F.col("id") == F.col("place")).select("key", "id", "ni", small, F.col("m").alias("xm"), t.alias("xt"))
        late = stored(late, "open-lines")
        release(met.sparkSession)
        earlier = met.where(F.col("rank") <= upper if upper else F.lit(True)).join(late.select("key").distinct(), "key", "left_semi")
        earlier = earlier.join(sets.select("place", "m", "t"), F.col("id") == F.col("place"))
        earlier = stored(earlier.select(F.col("key").alias("k"), F.col("id").alias("y"), F.col("ni").alias("yni"), small.alias("ysmall"), F.col("m").alias("ym"), t.alias("yt")), "earlier-lines")
        release(met.sparkSession)
        more = _settled(late, earlier, sets, best=bool(upper))
        for old in (late, earlier):
            discard(old)
        found = found.unionByName(more)
    return found


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy, line_no) of every line to remove."""
    lines = Places(docs, doc_id, text).of(_lines(docs, doc_id, text))
    again = several(lines)
    once = firsts(lines, again)
    table, most = rarity(once)
    rarest = stored(shown(once, table, most), "line-words")
    met = _met(grams(rarest))
    discard(rarest)
    sets = _sets(stored(met.select(F.col("id").alias("place")).distinct(), "line-places"), lines)
    gone = _matched(met, sets)
    gone = sets.join(gone.select(F.col("x").alias("place")), "place", "left_semi").select("a", "b", F.col("place").alias("first"), F.lit(True).alias("gone"))
    fates = again.withColumn("gone", F.lit(False)).unionByName(gone).groupBy("a", "b").agg(F.min("first").alias("first"), F.max("gone").alias("gone"))
    fates = stored(fates, "line-fates")
    for old in (met, sets, again):
        discard(old)
    release(docs.sparkSession)
    few = F.broadcast(fates) if fates.count() <= BROADCAST_LINES else fates
    placed = lines.select("doc_id", "copy", "line_no", "place", *_identity())
    return placed.join(few, ["a", "b"]).where("gone OR place > first").select("doc_id", "copy", "line_no").distinct()


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no) of every line to remove, whatever its text."""
    return removed_lines(docs, doc_id, text).select("doc_id", "line_no").distinct()


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed") -> DataFrame:
    """``docs`` with the repeated lines cut from their texts, and a column ``removed`` of their numbers,
    which replaces one of that name.

    What to cut is broadcast where it is small, else joined by shuffle.
    """
    gone = removed_lines(docs, doc_id, text).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("line_no")).alias("cut"))
    gone = stored(gone, "removed-lines")
    lines, rows = gone.agg(F.sum(F.size("cut")), F.count("*")).first()
    small = F.broadcast(gone) if (lines or 0) + 8 * rows <= 4 * BROADCAST_LINES else gone.hint("shuffle_hash")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("id"), copy_of(docs, text).alias("md5"))
    joined = whole.join(small, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("md5") == F.col("copy")), "left")
    none, value = F.coalesce("cut", F.array().cast(INTS)), F.col("row")[text]

    def cut(gone: Column) -> Column:
        numbered = F.transform(F.split(value, "\n"), lambda line, k: F.struct(line.alias("line"), k.alias("k")))
        return F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains(gone, s["k"])), lambda s: s["line"]), "\n")

    made = F.when(F.size(none) > 0, let(none, cut)).otherwise(value)
    kept = [(made if c == text else F.col("row")[c]).alias(c) for c in docs.columns if c != removed]
    return joined.select(*kept, none.alias(removed))
