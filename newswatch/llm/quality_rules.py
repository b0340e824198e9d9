"""Quality rules whose cutoffs are chosen so that few good documents are lost, with proof.

Features are built-in Spark expressions. Each rule rejects a document whose feature is beyond
a cutoff. Labelled documents are the holdout: per stratum, rule and candidate cutoff, let n be
the good ones and k those the cutoff rejects. A cutoff is safe if, were its true rate of false
rejection above the rule's share of the risk, k or fewer rejections had a probability of at
most the corrected level: P(Binomial(n, risk / rules) <= k) <= level / (strata * rules * cutoffs)
(Bonferroni over everything tested, so the cutoffs may be chosen by the same labels). Of the
safe cutoffs the one with the best balance is taken, a lost good document weighing as much as
`worth` caught bad ones; a rule without one rejects nothing in that stratum. So with
probability 1 - level, no stratum loses more than `risk` of its good documents.

The holdout counts are sums over all labelled documents; the table of tests has one row per
stratum, rule and cutoff.

Defined results: a null or empty text has no words and fails the base rules; a null or unknown
stratum (one without labels) has no cutoffs, so only the base rules hold there; a document
labelled more than once is good if any label says so; rows with equal ids are judged one by
one; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.llm.common import SPACES, text_of, written

SYMBOLS = "#*$%&|<>"
SEPARATORS = "[\\x20\\x09-\\x0D]+"
MOST_STRATA = 10_000  # the cutoffs, one row per stratum, are broadcast up to so many


@dataclass(frozen=True)
class Rule:
    """Reject where `feature` is above (or below) a cutoff; `cutoffs` from strict to lenient."""

    name: str
    feature: Callable[[], Column]
    above: bool
    cutoffs: tuple[float, ...]


def ratio(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


RULES = (
    Rule("symbols", lambda: ratio("n_symbols", "word_chars"), True, (0.02, 0.05, 0.1, 0.2, 0.3)),
    Rule("duplicate lines", lambda: ratio("n_dup_lines", "n_lines"), True, (0.1, 0.2, 0.3, 0.5)),
    Rule("repeated words", lambda: ratio("n_repeat_words", "n_words"), True, (0.1, 0.2, 0.3, 0.4)),
    Rule("long words", lambda: ratio("word_chars", "n_words"), True, (6.5, 7.0, 8.0, 10.0)),
    Rule("short words", lambda: ratio("word_chars", "n_words"), False, (4.2, 4.0, 3.5, 3.0)),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in three-word windows found at least twice."""

    def covered(places: Column) -> Column:
        # A window covers three words, or up to the next repeated window's start if that is nearer.
        steps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places)), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))

    def repeats(ordered: Column) -> Column:
        # Equal windows are neighbours; pair each with the next and keep both places of equal ones.
        following = F.slice(ordered, 2, F.size(ordered))
        leading = F.slice(ordered, 1, F.size(ordered) - 1)
        pairs = F.filter(F.zip_with(leading, following, lambda a, b: F.struct((a["w"] == b["w"]).alias("same"), a["i"].alias("a"), b["i"].alias("b"))), lambda p: p["same"])
        return F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["a"], p["b"])))))

    windows = F.zip_with(
        F.slice(words, 1, F.size(words) - 2),
        F.zip_with(F.slice(words, 2, F.size(words) - 2), F.slice(words, 3, F.size(words) - 2), lambda b, c: F.struct(b.alias("b"), c.alias("c"))),
        lambda a, bc: F.xxhash64(a, bc["b"], bc["c"]),
    )
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(placed, lambda o: let(repeats(o), covered)))


def counts(text: Column) -> list[Column]:
    """The counts of a text as one expression each; words are cut once."""
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).cast("long").alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return [
        by_word.alias("by_word"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_line.alias("by_line"),
    ]


def binomial_tail(n: Column, k: Column, p: float, terms: int = 400) -> Column:
    """P(Binomial(n, p) <= k) for k < n p, never below the true value; 1 where k >= n p.

    Terms are added downward from k, each less than the one before by a factor below 1; what
    lies beyond `terms` of them is at most a geometric rest, which is added.
    """

    def log_gamma(x: Column) -> Column:  # Stirling's series at x + 8, brought back by the product
        y = x + 8
        series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
        product = x
        for step in range(1, 8):
            product = product * (x + step)
        return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)

    n, k = n.cast("double"), k.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))

    def add(state: Column, j: Column) -> Column:
        left = F.greatest(k - j, F.lit(0.0))
        shrunk = state["term"] * left * (1 - p) / ((n - left + 1) * p)
        return F.struct((state["sum"] + state["term"]).alias("sum"), shrunk.alias("term"))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(terms)), F.struct(F.lit(0.0).alias("sum"), first.alias("term")), add)
    shrink = k * (1 - p) / ((n - k + 1) * p)
    bound = let(total, lambda t: t["sum"] + t["term"] / (1 - shrink))
    return F.when(k < n * p, F.least(F.lit(1.0), bound)).otherwise(F.lit(1.0))


def cutoffs(held: DataFrame, labels: DataFrame, risk: float, level: float, rules: tuple[Rule, ...] = RULES, worth: int = 20) -> DataFrame:
    """Per stratum and rule, the chosen cutoff: stratum, rule, cutoff, n_good, lost_good, caught_bad."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = held.filter(~F.col("base_failed") & F.col("stratum").isNotNull()).join(known.filter("quality IS NOT NULL"), "doc_id")
    tests = [
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), ((rule.feature() > c) if rule.above else (rule.feature() < c)).alias("hit"))
        for r, rule in enumerate(rules)
        for c in rule.cutoffs
    ]
    one = judged.select("stratum", "quality", F.explode(F.array(*tests)).alias("t")).select("stratum", "quality", "t.*")
    tally = written(
        one.groupBy("stratum", "rule", "cutoff").agg(
            F.count_if(F.col("quality") > 0).alias("n_good"),
            F.count_if((F.col("quality") > 0) & F.col("hit")).alias("lost_good"),
            F.count_if((F.col("quality") <= 0) & F.col("hit")).alias("caught_bad"),
        ),
        "rule-tests",
    )
    n_tests = tally.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_tests"))
    tested = tally.withColumn("tail", binomial_tail(F.col("n_good"), F.col("lost_good"), risk / len(rules)))
    level_each = F.lit(level) / n_tests.select("n_tests").scalar()
    best = F.max_by(F.struct("cutoff", "n_good", "lost_good", "caught_bad"), F.struct("balance", -F.col("lost_good"), "cutoff"))
    balance = F.col("caught_bad") - worth * F.col("lost_good")
    safe = tested.filter(F.col("tail") <= level_each).withColumn("balance", balance).filter("balance > 0")
    return safe.groupBy("stratum", "rule").agg(best.alias("best")).select("stratum", "rule", "best.*")


def verdicts(held: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`held` with `kept`: not failed by the base rules nor beyond a chosen cutoff of its stratum."""
    pairs = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))  # at most one per rule
    by_stratum = written(chosen.groupBy("stratum").agg(pairs.alias("limits")), "cutoffs")
    small = by_stratum.count() <= MOST_STRATA
    beyond = F.lit(False)
    for r, rule in enumerate(rules):
        limit = F.element_at("limits", r)
        beyond = beyond | F.coalesce(rule.feature() > limit if rule.above else rule.feature() < limit, F.lit(False))
    joined = held.join(F.broadcast(by_stratum) if small else by_stratum, "stratum", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("limits")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """The counts and the verdict of every document: texts are read once, the counts kept for calibration."""
    held = written(_flat(docs), "quality-counts")
    return verdicts(held, cutoffs(held, labels, risk, level))


def _flat(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of every document."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").alias("stratum"), text_of("text").alias("text"))
    return _named(base.select("doc_id", "stratum", *counts(F.col("text"))))


def _named(counted: DataFrame) -> DataFrame:
    flat = counted.select(
        *[c for c in counted.columns if c not in ("by_word", "by_line")],
        F.col("by_word.n").alias("n_words"),
        F.col("by_word.r").alias("n_repeat_words"),
        F.col("by_line.n").alias("n_lines"),
        F.col("by_line.d").alias("n_dup_lines"),
    )
    return flat.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def good_documents(docs: DataFrame, labels: DataFrame, risk: float = 0.02, level: float = 0.05) -> DataFrame:
    """The rows of `docs`, all columns, that the rules keep.

    Texts are counted once to choose the cutoffs (only counts are written) and once to apply them, so no
    text is shuffled or written. The counts go through an explode of one struct: the filter stays above it and
    does not work them out again.
    """
    chosen = cutoffs(written(_flat(docs), "quality-counts"), labels, risk, level)
    inner = uuid.uuid4().hex  # no column of `docs` has such a name
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(inner)
    base = docs.select(row, F.col("lang").alias("stratum"), text_of("text").alias("text"))
    counted = base.select(inner, "stratum", F.explode(F.array(F.struct(*counts(F.col("text"))))).alias("counted")).select(inner, "stratum", "counted.*")
    kept = verdicts(_named(counted), chosen).filter("kept")
    return kept.select(*[F.col(inner)[c].alias(c) for c in docs.columns])
