"""Quality rules as learned decision lists.

Statistics of labelled texts are counted into threshold cells by Spark; sequential covering grows
conjunctions of thresholds for either verdict on two thirds of them, prunes each on the rest, and emits the list
as one ordered Spark conditional expression. Built-in functions only.

The list is fitted on at most ``MAX_LABELLED`` labelled texts, chosen by a hash of their ids, so that
its cost doesn't grow with the corpus; it is applied to all rows. Defined results: a null or empty text
has no words and fails the base rules; rows stay as often as they come; labels that are null count as
missing, contradicting ones as the lower; without labels the list is empty and keeps what the base
rules keep.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import discard, let, positions, stored, texts

#: Bound on the labelled texts that a list is fitted on.
MAX_LABELLED = 20_000
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Thresholds of a feature are its quantiles among the labelled texts, in so many steps.
STEPS = 32
#: A rule that keeps needs so many texts among the pruning third, and such a share of all it covers: rules after it never
#: see what it covers. One that rejects needs such a share there too.
LEAST_COVERED = 5
LEAST_PRECISION = {"reject": 0.9, "keep": 0.99}
#: Precision by Laplace's rule of a rule that rejects, on the pruning third and on all labelled texts that are left: few
#: texts have to be pure, many may hold some of the other verdict.
LEAST_LAPLACE = {"prune": 0.8, "all": 0.9}


def _repeated(ws: Column) -> Column:
    """Words that stand in windows of five which occur twice or more, the first included.

    Windows are compared by 64-bit hashes; two that differ within one text of a million words agree
    with a probability of 3e-8.
    """

    def covered(at: Column) -> Column:
        ends = F.concat(F.slice(at, 2, F.size(at)), F.array(F.element_at(at, -1) + WINDOW))
        return F.aggregate(F.zip_with(at, ends, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda n, x: n + x)

    def of_hashes(hs: Column) -> Column:
        marked = F.sort_array(F.transform(hs, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        twice = let(
            marked,
            lambda ms: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            ms,
                            lambda m, k: F.struct(
                                m["k"].alias("k"),
                                ((F.get(ms, k - 1)["h"] == m["h"]) & (k > 0) | (F.get(ms, k + 1)["h"] == m["h"])).alias("twice"),
                            ),
                        ),
                        lambda m: F.coalesce(m["twice"], F.lit(False)),
                    ),
                    lambda m: m["k"],
                )
            ),
        )
        return let(twice, covered)

    hashes = F.transform(positions(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
    count = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(of_hashes(hs)))
    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(count)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_upper and
    n_chars of each whole text (replacing columns of these names)."""
    value = texts(df, text)
    lines = F.filter(F.split(value, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    made = F.struct(
        let(
            F.array_remove(F.split(value, SPACES), ""),
            lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeated(ws).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        F.length(F.regexp_replace(value, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(value) - F.length(F.regexp_replace(value, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(value) - F.length(F.regexp_replace(value, r"[!?]+", ""))).cast("long").alias("n_marks"),
        (F.length(value) - F.length(F.regexp_replace(value, r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        let(lines, lambda ls: F.size(ls).cast("long")).alias("n_lines"),
    )
    one = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), made.alias("stats"))
    s = F.col("stats")
    found = {"n_words": s["w"]["n_words"], "n_repeat_words": s["w"]["n_repeat_words"]}
    found |= {c: s[c] for c in ("word_chars", "n_symbols", "n_marks", "n_upper", "n_dup_lines", "n_lines")}
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in found]
    return one.select(*kept, *[c.alias(name) for name, c in found.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The features of the rules, from the columns of ``statistics``."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` at or above (``above``) or below a threshold."""

    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, float]) -> bool:
        return (values[self.feature] >= self.threshold) == self.above

    def column(self) -> Column:
        value, least = features()[self.feature], F.lit(self.threshold)
        return value >= least if self.above else value < least

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction and its verdict, ``reject`` or ``keep``."""

    conditions: tuple[Condition, ...]
    verdict: str

    def holds(self, values: dict[str, float]) -> bool:
        return all(c.holds(values) for c in self.conditions)

    def __str__(self) -> str:
        return f"{self.verdict} if {' and '.join(map(str, self.conditions))}"


@dataclass(frozen=True)
class DecisionList:
    """Rules of which the first that covers a text decides; a text that none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def keeps(self) -> Column:
        out: Column | None = None
        for rule in self.rules:
            met = F.lit(True)
            for condition in rule.conditions:
                met = met & condition.column()
            out = (F if out is None else out).when(met, F.lit(rule.verdict == "keep"))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), "else keep"])


@dataclass(frozen=True)
class Cell:
    """Labelled texts that no threshold tells apart. ``values``: the greatest threshold that each feature reaches."""

    values: dict[str, float]
    grow: bool
    verdict: str
    n: int


Grid = dict[str, tuple[float, ...]]


def cells(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[Cell], Grid]:
    """Counts of labelled texts by cell, not more cells than ``most``; and the thresholds.

    The labelled texts are stored before anything is computed from them, so that no other text is looked at.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled-texts")
    values = [value.cast("double").alias(name) for name, value in features().items()]
    verdict = F.when(F.col("quality") == 0, "reject").otherwise("keep").alias("verdict")
    judged_ = statistics(rows).where(~base_failed()).select(*values, (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), verdict)
    measured = stored(judged_, "labelled-statistics")
    shares = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    found = measured.agg(*[F.percentile(name, shares).alias(name) for name in features()]).first()
    grid = {name: tuple(sorted(set(found[name] or ()))) for name in features()}
    lowest = {name: grid[name][0] if grid[name] else 0.0 for name in grid}

    def reached(name: str) -> Column:
        steps = F.array(*[F.lit(t) for t in grid[name]]) if grid[name] else F.array().cast("array<double>")
        return F.coalesce(F.array_max(F.filter(steps, lambda t: t <= F.col(name))), F.lit(lowest[name])).alias(name)

    counted = measured.select(*map(reached, grid), "grow", "verdict").groupBy(*grid, "grow", "verdict").agg(F.count("*").alias("n")).collect()
    discard(rows)
    discard(measured)
    order = sorted(counted, key=lambda r: ([r[name] for name in grid], r["grow"], r["verdict"]))
    return [Cell({name: r[name] for name in grid}, r["grow"], r["verdict"], r["n"]) for r in order], grid


def _counts(some: list[Cell], verdict: str, conditions: tuple[Condition, ...]) -> tuple[int, int]:
    """Texts of the verdict, and others, that the conditions cover."""
    met = [c for c in some if all(x.holds(c.values) for x in conditions)]
    right = sum(c.n for c in met if c.verdict == verdict)
    return right, sum(c.n for c in met) - right


def _grown(some: list[Cell], grid: Grid, verdict: str) -> tuple[Condition, ...]:
    """The conjunction that greedy FOIL gain reaches; of equal gains, the threshold that covers least."""
    rule: tuple[Condition, ...] = ()
    p, n = _counts(some, verdict, rule)
    while p and n:
        best, gain = None, 0.0
        for name, steps in grid.items():
            tallies = {t: [0, 0] for t in steps}
            for c in some:
                tallies[c.values[name]][c.verdict != verdict] += c.n
            under = [0, 0]
            for t in steps:  # below t is what ``under`` has, at or above it the rest
                for above in (True, False):
                    p1, n1 = (p - under[0], n - under[1]) if above else under
                    g = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n))) if p1 else 0.0
                    same = best is not None and (best.feature, best.above) == (name, above)
                    if g > gain + 1e-9 or above and same and g > gain - 1e-9:
                        best, gain = Condition(name, above, t), g
                under = [a + b for a, b in zip(under, tallies[t])]
        if best is None:
            break
        rule = (*rule, best)
        some = [c for c in some if best.holds(c.values)]
        p, n = _counts(some, verdict, ())
    return rule


def _pruned(some: list[Cell], verdict: str, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The prefix of a rule with the best balance on the cells kept for pruning."""

    def value(k: int) -> tuple[float, int]:
        p, n = _counts(some, verdict, rule[:k])
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return rule[: max(range(1, len(rule) + 1), key=value)] if rule else rule


def _trusted(left: list[Cell], prune: list[Cell], verdict: str, conditions: tuple[Condition, ...]) -> bool:
    """Whether a rule holds on labelled texts that it wasn't grown on."""
    p, n = _counts(prune, verdict, conditions)
    if p < LEAST_PRECISION[verdict] * (p + n):
        return False
    if verdict == "keep":
        return p >= LEAST_COVERED
    p_all, n_all = _counts(left, verdict, conditions)
    return p + 1 >= LEAST_LAPLACE["prune"] * (p + n + 2) and p_all + 1 >= LEAST_LAPLACE["all"] * (p_all + n_all + 2)


def learn(some: list[Cell], grid: Grid) -> DecisionList:
    """Sequential covering: a rule that rejects, or where none is right often enough and precisely enough, one that
    keeps; what it covers is left out of the next, which may reject again."""
    rules: list[Rule] = []
    left = list(some)
    while True:
        grow, prune = [c for c in left if c.grow], [c for c in left if not c.grow]
        for verdict in ("reject", "keep"):
            conditions = _pruned(prune, verdict, _grown(grow, grid, verdict))
            if conditions and _trusted(left, prune, verdict, conditions):
                rules.append(Rule(conditions, verdict))
                left = [c for c in left if not rules[-1].holds(c.values)]
                break
        else:
            while rules and rules[-1].verdict == "keep":  # what follows keeps anyway
                rules.pop()
            return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DecisionList:
    return learn(*cells(docs, labels, most))


def judged(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    return statistics(docs, text).withColumns({"base_failed": base_failed()}).withColumns({"kept": ~F.col("base_failed") & rules.keeps()})
