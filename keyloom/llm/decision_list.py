"""Quality rules: text statistics and decision lists learned from labelled rows by sequential covering.

Everything on the path of the data is a column expression; the driver only sees counts per feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACES, let
from keyloom.session import materialize

WINDOW = 8

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Statistics the rules may test, per word or per character where that makes them independent of a text's length.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "upper_share")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value < threshold
    threshold: float

    def column(self, stats: Column) -> Column:
        value = stats[self.feature]
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    """Rejects a row that meets all conditions."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def column(self, stats: Column) -> Column:
        met = self.conditions[0].column(stats)
        for c in self.conditions[1:]:
            met = met & c.column(stats)
        return met


def text_stats(text: Column) -> Column:
    """Struct of the base statistics and the features of a whole text; a NULL text has no words.

    Words are what lies between ASCII white space. ``n_repeat_words`` are the words of 8-word windows found twice or
    more (windows are compared by 64-bit hash). ``n_dup_lines`` are lines with a word that equal an earlier line.
    """
    return let(F.coalesce(text.cast("string"), F.lit("")), _stats_of_text)


def _stats_of_text(text: Column) -> Column:
    words = F.filter(F.split(text, SPACES), lambda w: w != F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    pure = F.struct(
        words.alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("upper"),
    )
    return let(pure, _named_stats)


def _named_stats(p: Column) -> Column:
    n_words = F.size(p["words"]).cast("long")
    each = F.greatest(n_words, F.lit(1)).cast("double")
    lines = F.greatest(F.size(p["lines"]), F.lit(1)).cast("double")
    base = F.struct(
        n_words.alias("n_words"),
        F.aggregate(p["words"], F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        p["symbols"].cast("long").alias("n_symbols"),
        (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("long").alias("n_dup_lines"),
        repeated_words(p["words"]).cast("long").alias("n_repeat_words"),
    )
    return let(base, lambda b: F.struct(
        *[b[c].alias(c) for c in BASE],
        (b["word_chars"] / each).alias("mean_word"),
        (b["n_symbols"] / each).alias("symbols_per_word"),
        (b["n_dup_lines"] / lines).alias("dup_line_share"),
        (b["n_repeat_words"] / each).alias("repeat_share"),
        (F.size(F.array_distinct(p["words"])) / each).alias("distinct_share"),
        (p["upper"] / F.greatest(b["word_chars"], F.lit(1)).cast("double")).alias("upper_share"),
    ))


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a window of 8 words that is found twice or more.

    The hash of a window is made of those of its halves, so three passes over the words make the hashes of all.
    """

    def doubled(step: int):
        return lambda hashes: F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))

    singles = F.transform(words, lambda w: F.xxhash64(w))
    whole = let(let(let(singles, doubled(1)), doubled(2)), doubled(4))
    hashes = F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.slice(whole, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    )
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, WINDOW)))


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash is not alone: the sorted starts add what lies before the next start."""
    sorted_pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(pairs: Column) -> Column:
        def alone(k: Column) -> Column:
            own = F.get(pairs, k)["h"]
            before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
            return ~(own.eqNullSafe(before) | own.eqNullSafe(after))

        order = F.sequence(F.lit(0), F.size(pairs) - 1)
        return F.sort_array(F.transform(F.filter(order, lambda k: ~alone(k)), lambda k: F.get(pairs, k)["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(sorted_pairs, starts), total)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (stats["n_repeat_words"] * 100 > stats["n_words"] * 30)


def learn(
    rows: DataFrame, bins: int = 24, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.9, least: int = 8
) -> list[Rule]:
    """Ordered rules for the rows with label 0, from ``rows(stats, label, key)`` with a statistics struct.

    Sequential covering: a rule grows by the condition with the highest gain on two thirds of the rows (chosen by a
    hash of ``key``), is pruned to the prefix that does best on the other third, and is kept if it covers at least
    ``least`` rows with at least ``precision`` of label 0 on both parts together. Rows that it covers leave, and the
    next rule begins. Each step is one aggregation over all labelled rows, which gives counts per feature, bin and
    label; thresholds lie midway between neighbouring ``bins``-quantiles of the two labels. Rows without a label or statistics take no part.
    Without rows of both labels there are no rules.
    """
    wide = rows.where("label IN (0, 1) AND stats IS NOT NULL").select(
        *[F.col(f"stats.{f}").cast("double").alias(f) for f in FEATURES], F.col("label").cast("int").alias("label"),
        (F.pmod(F.xxhash64("key"), F.lit(3)) > 0).alias("grow"),
    )
    wide = materialize(wide, "labelled-stats")
    shares = [i / bins for i in range(bins + 1)]
    sides = wide.groupBy("label").agg(*[F.percentile_approx(f, shares, 10000).alias(f) for f in FEATURES]).collect()
    if len(sides) < 2:
        return []
    values = {f: sorted({v for side in sides for v in side[f]}) for f in FEATURES}
    thresholds = {f: [(a + b) / 2 for a, b in zip(v, v[1:])] for f, v in values.items()}
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most_rules:
        conditions = _grow(wide.where(left & F.col("grow")), thresholds, most_conditions)
        rule = _pruned(wide.where(left), conditions, precision, least)
        if rule is None:
            break
        rules.append(rule)
        left = left & ~_met(rule.conditions)
    return rules


def _met(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & (F.col(c.feature) >= F.lit(c.threshold) if c.above else F.col(c.feature) < F.lit(c.threshold))
    return out


def _binned(thresholds: list[float], feature: str) -> Column:
    """Number of thresholds that the value reaches."""
    out = F.lit(0)
    for t in thresholds:
        out = out + F.when(F.col(feature) >= F.lit(t), 1).otherwise(0)
    return out


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], most: int) -> list[Condition]:
    """Conditions in the order in which they raise the share of label 0 most (gain weighted by the rows kept)."""
    chosen: list[Condition] = []
    while len(chosen) < most:
        each = F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), _binned(thresholds[f], f).alias("bin")) for f in FEATURES
        ]))
        counts: dict[str, dict[int, list[int]]] = {f: {} for f in FEATURES}
        binned = rows.where(_met(chosen)).select(each.alias("e"), "label")
        for r in binned.groupBy("e.feature", "e.bin", "label").count().collect():
            counts[r["feature"]].setdefault(r["bin"], [0, 0])[r["label"]] += r["count"]
        bad, good = (sum(x[k] for x in counts[FEATURES[0]].values()) for k in (0, 1))
        if not bad or not good:
            break
        start = math.log2(bad / (bad + good))
        best, found = 1e-9, None
        for f in FEATURES:
            below = [0, 0]
            for i, t in enumerate(thresholds[f]):
                below = [below[k] + counts[f].get(i, [0, 0])[k] for k in (0, 1)]
                for above, (b, g) in ((False, below), (True, [bad - below[0], good - below[1]])):
                    gain = b * (math.log2(b / (b + g)) - start) if b else 0
                    if gain > best:
                        best, found = gain, Condition(f, above, t)
        if found is None:
            break
        chosen.append(found)
    return chosen


def _pruned(rows: DataFrame, conditions: list[Condition], precision: float, least: int) -> Rule | None:
    """The prefix of ``conditions`` that is worth most on the rows held back, if it is precise enough on all."""
    if not conditions:
        return None
    sums = []
    for n in range(1, len(conditions) + 1):
        for label in (0, 1):
            met = _met(conditions[:n]) & (F.col("label") == label)
            sums += [F.count_if(met), F.count_if(met & ~F.col("grow"))]
    got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).head())
    best = None
    for n in range(1, len(conditions) + 1):
        bad, held_bad, good, held_good = got[4 * (n - 1) : 4 * n]
        if bad + good < least or bad < precision * (bad + good):
            continue
        worth = (held_bad - held_good) / max(1, held_bad + held_good)
        if best is None or worth > best[0]:
            best = (worth, Rule(tuple(conditions[:n]), bad + good, bad / (bad + good)))
    return best and best[1]


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """False where the base test fails; else false if one of the rules, in their order, is met; else true."""
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(stats), F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, base statistics, base_failed, kept) for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality)`` names good (1) and bad (0) documents; the rules are learned from those that pass the
    base test. Statistics are computed once and written to the shared folder. NULL texts have no words and fail.
    """
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_stats(F.col("text")).alias("stats"))
    stats = materialize(stats, "text-stats")
    rules = learned_rules(stats, labels)
    return stats.select(
        "doc_id", *[F.col(f"stats.{c}").alias(c) for c in BASE], base_failed(F.col("stats")).alias("base_failed"),
        verdict(F.col("stats"), rules).alias("kept"),
    )


def learned_rules(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from the rows of ``stats(doc_id, stats)`` that pass the base test and have a label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = stats.where(~base_failed(F.col("stats"))).join(known, "doc_id")
    return learn(rows.select("stats", "label", F.col("doc_id").alias("key")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the base test and the learned rules keep, with all their columns."""
    stats = F.struct(text_stats(F.col("text")).alias("s"))
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), stats["s"].alias("stats"))
    rules = learned_rules(materialize(labelled, "labelled-texts"), labels)
    return docs.where(let(text_stats(F.col("text")), lambda s: verdict(s, rules)))
