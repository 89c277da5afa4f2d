"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a Boolean column that is true for a document to reject.  The cascade measures, on a
bounded sample, the time each rule takes and the share it rejects, and then tests the rules in the
order of rejections per second: ``CASE WHEN`` stops at the first that rejects, so the dear rules see
few rows.  The order changes the time and the name of the first failing rule, never the verdict.

Defined cases: a null text has no words and fails ``few_words``; an empty table gives an empty
result; repeated rows are judged alike; other columns pass through untouched.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that a text has at least twice.

    Windows are compared by a 64-bit hash within one text.  Only texts whose windows aren't all
    distinct pay for the sort that finds the covered positions.
    """

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)])),
        )

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            hits = F.filter(p, lambda s, j: F.coalesce(F.get(p, j - 1)["x"] == s["x"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["x"] == s["x"], F.lit(False)))
            return F.sort_array(F.transform(hits, lambda s: s["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, repeated), total)

    def count(w: Column) -> Column:
        return F.when(w.isNull() | (F.size(F.array_distinct(w)) == F.size(w)), F.lit(0)).otherwise(covered(w))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return let(let(hashes, windows), count).cast("long")


def measures(text: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": n_words(words),
        "word_chars": word_chars(words),
        "n_symbols": n_matches(text, SYMBOLS),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(words),
    }


def extra_measures(text: Column) -> dict[str, Column]:
    return {
        "n_capitals": n_matches(text, "[A-Z]"),
        "n_exclamations": n_matches(text, "!"),
        "n_lines": n_matches(text, "\n") + 1,
    }


@dataclass(frozen=True)
class Rule:
    """``needs`` names the measures that ``rejects`` reads; it gets the columns by name."""

    name: str
    needs: tuple[str, ...]
    rejects: object

    def column(self, have: dict[str, Column]) -> Column:
        return F.coalesce(self.rejects(*[have[x] for x in self.needs]), F.lit(False))


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
EXTRA_RULES = (
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s >= n),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("capitals", ("n_capitals", "word_chars"), lambda c, n: 2 * c > n),
    Rule("exclamation", ("n_exclamations", "n_words"), lambda e, n: 2 * e > n),
)


def all_measures(text: Column, words: Column) -> dict[str, Column]:
    return measures(text, words) | extra_measures(text)


#: Rows of the sample, and rows that a rule is timed on (the sample again and again).
SAMPLE_ROWS, REPEATED_ROWS = 512, 4096


def hash_sample(df: DataFrame, text: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts of all files, by a hash of the text: the same for each run.  Repeated texts
    come or go together; at most four times as many rows are returned."""
    total = df.count()
    share = max(1, total // max(sample_rows, 1))
    chosen = df.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(share)) == 0) if share > 1 else df
    return chosen.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).limit(4 * sample_rows)


def rule_order(df: DataFrame, text: str, rules: tuple[Rule, ...], sample_rows: int = SAMPLE_ROWS, known: dict[str, Column] | None = None) -> list[Rule]:
    """Rules by rejections per cost on a sample; dearer and milder ones last.

    A rule's cost is what it adds to a scan of the sample: the sample is repeated so often that the
    rule's own work outweighs the start of a job, it is run once to compile and then timed, and the time
    of a scan without a rule is taken off.  ``known``: measures that the caller has computed anyway; a
    rule that reads only these isn't charged for them."""
    sample = hash_sample(df, text, sample_rows)
    sample = sample.select("text", words_of(F.col("text")).alias("words"))
    have = all_measures(F.col("text"), F.col("words"))
    if known is not None:
        sample = sample.select("text", "words", *[have[k].alias(k) for k in known])
        have = have | {k: F.col(k) for k in known}
    sample = sample.cache()
    try:
        total = sample.count()
        if not total:
            return list(rules)
        often = F.explode(F.sequence(F.lit(1), F.lit(max(1, REPEATED_ROWS // total))))
        many = sample.select("*", often.alias("time"))

        def timed(x: Column) -> tuple[int, float]:
            # the repeat's number is part of the value, so that no repeat is computed once for all
            query = many.agg(F.sum(x.cast("long")), F.count("time"))
            query.first()
            began = time.perf_counter()
            return query.first()[0] or 0, time.perf_counter() - began

        _, scan = timed(F.length("text") < 0)
        ranked = []
        for rule in rules:
            rejected, spent = timed(rule.column(have))
            ranked.append((-(rejected + 0.5) / max(spent - scan, 0.05 * scan), rule.name, rule))
        return [x[2] for x in sorted(ranked, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def first_failing(rules: list[Rule], have: dict[str, Column]) -> Column:
    out = None
    for rule in rules:
        out = F.when(rule.column(have), rule.name) if out is None else out.when(rule.column(have), rule.name)
    return F.lit(None).cast("string") if out is None else out


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``df`` that no rule rejects, all columns kept."""
    order = rule_order(df, text, rules, sample_rows)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the words are bound inside the expression: as a column the optimizer would split the text once a rule
    failing = let(words_of(body), lambda w: first_failing(order, all_measures(body, w)))
    return df.where(failing.isNull())


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: the base measures, whether a base rule fails, and the verdict."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = df.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), words_of(body).alias("words"))
    base = measures(F.col("text"), F.col("words"))
    order = rule_order(df, text, EXTRA_RULES, sample_rows, base)
    out = out.select("doc_id", "text", *[v.alias(k) for k, v in base.items()])
    have = {k: F.col(k) for k in base} | extra_measures(F.col("text"))
    out = out.withColumn("base_failed", BASE_RULES[0].column(have) | BASE_RULES[1].column(have))
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_failing(order, have).isNull())
    return out.withColumn("kept", verdict).drop("text")
