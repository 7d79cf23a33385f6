"""Quality rules learned as an ordered decision list; DataFrame functions only.

Statistics of whole texts are array expressions within one row: no shuffle, no grouping by text. A bounded labelled
sample of such statistics goes to the driver, where sequential covering grows and prunes threshold conjunctions; the
resulting list is one nested ``when`` expression that Spark evaluates over every row.
"""
from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, query, table

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8
FEATURES = ("symbol_ratio", "mean_word", "repeat_share", "dup_line_share", "upper_share", "distinct_share")
#: Labelled rows of each class that learning collects, about.
SAMPLE_ROWS = 3000
#: Candidate thresholds per feature, and the limits of a rule.
CUTS, MAX_RULES, MAX_CONDITIONS, LEAST_COVER, LEAST_PRECISION = 48, 12, 4, 3, 0.95


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside the lambdas of ``use``."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside a window of eight that occurs twice or more in the row, by 64-bit window hashes.

    Windows are hashed in place. Only rows in which two hashes agree sort (hash, place) and walk the places of equal
    hashes, each adding what it covers beyond the one before: n log n for any text.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def walk(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            places = F.sort_array(F.transform(same, lambda x: x["i"]))
            start = F.struct(F.lit(-REPEAT_WORDS).alias("last"), F.lit(0).cast("long").alias("sum"))
            return F.aggregate(places, start, lambda acc, i: F.struct(
                i.alias("last"), (acc["sum"] + F.least(F.lit(REPEAT_WORDS), i - acc["last"]).cast("long")).alias("sum")), lambda acc: acc["sum"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bound(pairs, walk)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (REPEAT_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, REPEAT_WORDS)))
    return F.when(F.size(words) > REPEAT_WORDS, bound(windows, covered)).otherwise(F.lit(0).cast("long"))


def statistics(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the counts of the base rules and the features, over whole texts (null: no word)."""
    keep = keep or []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text.alias("__text"))
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(NOT_SPACE))
    parts = read.select("doc_id", *keep, F.array_remove(F.split(t, SPACE), "").alias("__words"), lines.alias("__lines"),
                        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
                        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"))
    words, lines = F.col("__words"), F.col("__lines")
    counted = parts.select("doc_id", *keep, "word_chars", "n_symbols", "n_upper", F.size(words).cast("long").alias("n_words"),
                           F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                           F.size(F.array_distinct(words)).cast("long").alias("n_distinct"), repeated_words(words).alias("n_repeat_words"))

    def share(a: str, b: str, name: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double").alias(name)

    return counted.select("*", share("n_symbols", "n_words", "symbol_ratio"), share("word_chars", "n_words", "mean_word"),
                          share("n_repeat_words", "n_words", "repeat_share"), share("n_dup_lines", "n_lines", "dup_line_share"),
                          share("n_upper", "word_chars", "upper_share"), share("n_distinct", "n_words", "distinct_share"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4f}"


Rule = tuple[Condition, ...]


def fires(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def grow(rows: list[tuple[dict, bool]]) -> Rule:
    """A conjunction that covers bad rows, each condition by the best information gain over its predecessors."""
    rule, covered = (), rows
    while len(rule) < MAX_CONDITIONS:
        p0 = sum(bad for _, bad in covered)
        if not p0 or p0 == len(covered):
            break
        before, best = log2(p0 / len(covered)), (1e-9, None)
        for feature in FEATURES:
            ordered = sorted((row[feature], bad) for row, bad in covered)
            step = max(1, len(ordered) // CUTS)
            p, seen = 0, 0
            for at, (value, bad) in enumerate(ordered[:-1]):
                p, seen = p + bad, seen + 1
                following = ordered[at + 1][0]
                if value == following or (seen % step and bad == ordered[at + 1][1]):
                    continue
                cut = (value + following) / 2
                for above, hit, n in ((False, p, seen), (True, p0 - p, len(ordered) - seen)):
                    gain = hit * (log2(hit / n) - before) if hit else 0.0
                    if gain > best[0]:
                        best = (gain, Condition(feature, above, cut))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        covered = [x for x in covered if best[1].holds(x[0])]
    return rule


def worth(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[float, int, int]:
    hit = [bad for row, bad in rows if fires(rule, row)]
    p, n = sum(hit), len(hit) - sum(hit)
    return ((p - n) / (p + n) if hit else -1.0), p, n


def learn_list(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Ordered rules that reject, from (statistics, is bad) rows; the first two of three rows grow, the third prunes."""
    rules: list[Rule] = []
    growing, pruning = [x for i, x in enumerate(rows) if i % 3 < 2], [x for i, x in enumerate(rows) if i % 3 == 2]
    while len(rules) < MAX_RULES and any(bad for _, bad in growing):
        rule = grow(growing)
        if not rule:
            break
        rule = max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (worth(r, pruning)[0], -len(r)))
        _, p, n = worth(rule, pruning + growing)
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule)
        growing = [x for x in growing if not fires(rule, x[0])]
        pruning = [x for x in pruning if not fires(rule, x[0])]
    return rules


def learn(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the rows with a quality label that may be learned from; no labels give no rules."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = bounded_sample(known.select("doc_id", "quality").distinct(), "quality", "doc_id", rows)
    # at most about twice ``rows`` ids, so this side may go to every executor
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = statistics(labelled, ["quality"]).select("doc_id", "quality", *FEATURES).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).collect()
    return learn_list([({f: r[f] for f in FEATURES}, r["quality"] == 0) for r in found])


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        fired = F.lit(True)
        for condition in rules[number - 1]:
            fired = fired & condition.column()
        out = F.when(fired, F.lit(number)).otherwise(out)
    return out


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, ``base_failed``, the rejecting ``rule`` and ``kept`` of every row.

    Null and empty texts have no words and fail the base rules. Repeated rows stay repeated; an empty table gives none.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (statistics(documents).withColumn("rule", verdict(rules)).withColumn("base_failed", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule"))


@query("op10_rules")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return judge(documents, learn(documents, table(spark, sf_dir, "labels")))
