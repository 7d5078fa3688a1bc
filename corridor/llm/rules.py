"""Quality rules: fixed base rules, then a decision list learned by sequential covering. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import BLANKS, bounded, settled, words

WINDOW = 5
#: The statistics that rules test, as whole numbers: thousandths of words, characters or lines, or the plain size.
STATS = ("n_words", "chars_per_word", "symbols", "dup_lines", "repeats", "capitals")
#: Thresholds tried for a statistic, at most; conjunctions and rules are kept short so that they can be read.
CUTS, MAX_TESTS, MAX_RULES = 12, 3, 8
#: A rule must cover this many labelled rows of its kind in the growing part and be this pure in both parts together.
LEAST_ROWS, PURITY = 5, 0.8
MAX_LABELLED, SEED = 200_000, 42


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals of each whole text.

    A null text has none of anything. n_repeat_words counts the words inside 5-word windows that occur twice or more
    in the text, the first occurrence included: positions of equal windows are sorted, and each adds what it does not
    share with the next. All of it stays within a row, so neither a long text nor copies meet a shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", words(text)).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    df = df.withColumn("_lines", lines)
    n = F.size("_words")
    at = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_windows", F.transform(at, lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(WINDOW)])))
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter(
        "_ordered",
        lambda x, k: F.coalesce((F.get("_ordered", k - 1)["h"] == x["h"]) | (F.get("_ordered", k + 1)["h"] == x["h"]), F.get("_ordered", k - 1)["h"] == x["h"], F.get("_ordered", k + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn("_places", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", k + 1) - p, F.lit(WINDOW))))
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, k: a + k),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        }
    ).drop("_words", "_hash", "_lines", "_windows", "_ordered", "_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_statistics() -> dict[str, Column]:
    """STATS of a row with base statistics; 0 where the divisor is."""

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.floor(1000 * F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("long")

    return {
        "n_words": F.col("n_words"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
    }


@dataclass(frozen=True)
class Rule:
    """Tests (statistic, whether at least, threshold) that must all hold, and whether a document is then kept."""

    tests: tuple[tuple[str, bool, int], ...]
    keep: bool

    def condition(self) -> Column:
        out = F.lit(True)
        for stat, at_least, cut in self.tests:
            out = out & ((F.col(stat) >= cut) if at_least else (F.col(stat) < cut))
        return out

    def __str__(self) -> str:
        said = " and ".join(f"{s} {'>=' if up else '<'} {c}" for s, up, c in self.tests)
        return f"if {said} then {'keep' if self.keep else 'drop'}"


@dataclass(frozen=True)
class Cells:
    """Labelled rows counted by the bins of their statistics: bins (cells x statistics), and good and bad rows (cells x 2)
    in the growing part and in the pruning part."""

    bins: np.ndarray
    grow: np.ndarray
    prune: np.ndarray

    def left(self, keep: np.ndarray) -> Cells:
        return Cells(self.bins[keep], self.grow[keep], self.prune[keep])

    def holds(self, tests: tuple[tuple[int, bool, int], ...]) -> np.ndarray:
        out = np.ones(len(self.bins), bool)
        for s, up, b in tests:
            out &= (self.bins[:, s] >= b) == up
        return out


def _worth(counts: np.ndarray, kind: int) -> np.ndarray:
    """Share of rows of a kind (last axis: good, bad), drawn towards even by a row of each."""
    return (counts[..., kind] + 1) / (counts.sum(-1) + 2)


def _grown(cells: Cells, n_bins: list[int], kind: int) -> tuple[tuple[int, bool, int], ...]:
    """The conjunction against rows of the other kind that grows purest, a test at a time."""
    tests: tuple[tuple[int, bool, int], ...] = ()
    while len(tests) < MAX_TESTS:
        inside = cells.holds(tests)
        total = cells.grow[inside].sum(0)
        best, best_worth = None, _worth(total, kind)
        for s, n in enumerate(n_bins):
            by = np.stack([np.bincount(cells.bins[inside, s], cells.grow[inside, k], n) for k in (0, 1)], 1)
            below = np.cumsum(by, 0)[:-1]  # of thresholds 1 to n - 1
            for up, counts in ((True, total - below), (False, below)):
                worth = np.where(counts[:, kind] >= LEAST_ROWS, _worth(counts, kind), 0)
                if n > 1 and worth.max() > best_worth + 1e-9:
                    best, best_worth = (s, up, int(worth.argmax()) + 1), worth.max()
        if best is None:
            break
        tests = (*tests, best)
    return tests


def _pruned(cells: Cells, tests: tuple[tuple[int, bool, int], ...], kind: int) -> tuple[tuple[int, bool, int], ...]:
    """Without the tests that the rule does no worse without on rows it was not grown on."""
    while len(tests) > 1:
        value = lambda t: float(_worth(cells.prune[cells.holds(t)].sum(0), kind))
        fewer = max((tests[:k] + tests[k + 1 :] for k in range(len(tests))), key=value)
        if value(fewer) < value(tests):
            break
        tests = fewer
    return tests


def cover(cells: Cells, n_bins: list[int]) -> list[tuple[tuple, bool]]:
    """Sequential covering: of the best conjunction that keeps and the best that drops, each grown and then pruned, the
    purer one becomes the next rule; what it covers is taken away. Later rules hold only where no earlier one does.

    Goes on while a pure enough rule is found; the last rule, without tests, is what most of the rows left say.
    """
    out: list[tuple[tuple, bool]] = []
    while len(out) < MAX_RULES and len(cells.bins):
        found = []
        for kind, keep in ((1, False), (0, True)):
            tests = _pruned(cells, _grown(cells, n_bins, kind), kind)
            inside = cells.holds(tests)
            grown, both = cells.grow[inside].sum(0), (cells.grow + cells.prune)[inside].sum(0)
            if tests and grown[kind] >= LEAST_ROWS and both[kind] >= PURITY * both.sum():
                found.append((float(_worth(both, kind)), keep, tests))
        if not found:
            break
        _, keep, tests = max(found, key=lambda f: (f[0], not f[1]))  # of two as pure, the one that drops
        out.append((tests, keep))
        cells = cells.left(~cells.holds(tests))
    good, bad = (cells.grow + cells.prune).sum(0) if len(cells.bins) else (0, 0)
    return [*out, ((), bool(good >= bad))]


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules from ``labelled`` (STATS, quality 0 or 1, grow). Rows are counted by bins of the statistics in one job.

    The cells gathered are bounded by the bins and by MAX_LABELLED. No labels: no rules.
    """
    quantiles = labelled.agg(*[F.percentile_approx(s, [k / (CUTS + 1) for k in range(1, CUTS + 1)] + [0.97, 0.99], 10_000) for s in STATS]).first()
    if quantiles is None or quantiles[0] is None:
        return []
    cuts = [sorted({q + 1 for q in qs}) for qs in quantiles]
    bins = [sum([(F.col(s) >= c).cast("int") for c in cs], F.lit(0)).alias(s) for s, cs in zip(STATS, cuts, strict=True)]
    mark = [F.count_if(F.col("_grow") & (F.col("_good") == k)) for k in (1, 0)] + [F.count_if(~F.col("_grow") & (F.col("_good") == k)) for k in (1, 0)]
    rows = labelled.select(*bins, F.col("quality").alias("_good"), F.col("grow").alias("_grow")).groupBy(*STATS).agg(*mark).collect()
    table = np.array(sorted(map(tuple, rows)), np.int64)
    found = cover(Cells(table[:, : len(STATS)], table[:, -4:-2], table[:, -2:]), [len(c) + 1 for c in cuts])
    return [Rule(tuple((STATS[s], up, cuts[s][b - 1]) for s, up, b in tests), keep) for tests, keep in found]


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds decides; true where none does."""
    out = None
    for r in rules:
        out = F.when(r.condition(), F.lit(r.keep)) if out is None else out.when(r.condition(), F.lit(r.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept (and rule: the place of the rule that decided, 0 without rules).

    Rules are learned from ``labels`` (doc_id, quality): an id labelled more than once counts as good where half say
    so or more; null ids and labels do not count. Rows that fail the base rules teach nothing and are not kept. A null
    or blank text has no words and fails. Repeated rows come out alike.
    """
    stats = settled(base_statistics(docs.select("doc_id", "text")).drop("text"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    named = rule_statistics()
    taught = stats.where(~base_failed()).join(bounded(marks, MAX_LABELLED, "doc_id"), "doc_id")
    grow = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(3)) > 0
    rules = learn(taught.select(*[c.alias(s) for s, c in named.items()], "quality", grow.alias("grow")))
    ruled = stats.withColumns({s: c for s, c in named.items() if s != "n_words"})
    which = F.lit(0)
    for k, r in reversed(list(enumerate(rules, 1))):
        which = F.when(r.condition(), k).otherwise(which)
    fails = base_failed()
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails.alias("base_failed"), (~fails & verdict(rules)).alias("kept"), which.alias("rule")
    )
