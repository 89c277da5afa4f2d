"""Secret scans through a trigram inverted index.

Each rule is a regular expression with the literals it cannot match without.  From these a Boolean
trigram query is derived: a disjunction, over the alternatives, of the conjunction of an
alternative's trigrams (in lower case).  The index holds a posting (trigram, row) for the trigrams
that some query reads; postings are pre-combined per row, intersected by query, and the surviving
candidates are verified with the regular expression.  A rule without mandatory trigrams scans all
texts.

Offsets count code points.  The text between the matches (``split``) and the matches
(``regexp_extract_all``) give them as running lengths, so the whole operator stays in column functions.

Defined cases: null is the empty text; an empty table gives an empty result; repeated rows share a
posting and get the same spans; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, row_key


@dataclass(frozen=True)
class SecretRule:
    """``any_of``: alternatives of which each match holds one whole; without them the rule scans
    fully.  ``value``: the regex group whose length must reach ``least``."""

    kind: str
    pattern: str
    value: int
    least: int
    any_of: tuple[str, ...] = ()

    def query(self) -> list[frozenset[str]]:
        """Disjunction of conjunctions of trigrams; empty: no mandatory trigram."""
        parts = [frozenset(s[i : i + 3] for s in [alt.lower()] for i in range(len(s) - 2)) for alt in self.any_of]
        return parts if parts and all(parts) else []


# The patterns of the base kinds, then those that the method adds.
BASE = (
    SecretRule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    SecretRule("access", r"(AKIA[A-Z0-9]+)", 1, 16, ("AKIA",)),
    SecretRule("hex", r"([0-9a-f]{32,})", 1, 32),
)
ADDED = (
    SecretRule("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 27, ("PRIVATE KEY-----",)),
    SecretRule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    SecretRule("google", r"(AIza[A-Za-z0-9_-]{35})", 1, 39, ("AIza",)),
    SecretRule("bearer", r"([bB]earer [A-Za-z0-9._~+/-]{20,}=*)", 1, 27, ("bearer ",)),
)
RULES = BASE + ADDED


def trigrams(rules: tuple[SecretRule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for alt in r.query() for t in alt})


def postings(rows: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, key) of ``rows`` (key, text), for the trigrams the rules read.

    Each wanted trigram is looked for in the lower-cased text.
    """
    wanted = trigrams(rules)
    low = F.lower("text")
    present = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]), lambda x: x.isNotNull())
    return rows.select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Rows (key, hits) that satisfy the query of some rule; hits has bit i for rule i."""
    wanted = {t: i for i, t in enumerate(trigrams(rules))}
    if not wanted:
        return index.select("key", F.lit(0).cast("long").alias("hits")).where("false")
    # one word of 60 bits for each 60 trigrams
    n = (len(wanted) + 59) // 60
    bit = {t: (i // 60, 1 << (i % 60)) for t, i in wanted.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for t, i in wanted.items() for x in (t, i)]), F.col("trigram"))
    has = [F.bit_or(F.when(F.floor(F.col("number") / 60) == w, F.expr("shiftleft(1L, CAST(number % 60 AS INT))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(n)]
    joined = index.withColumn("number", number).groupBy("key").agg(*has)

    def satisfied(rule: SecretRule) -> Column:
        out = F.lit(False)
        for alt in rule.query():
            need = [sum({bit[t][1] for t in alt if bit[t][0] == w}) for w in range(n)]
            every = F.lit(True)
            for w, m in enumerate(need):
                if m:
                    every = every & (F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long"))
            out = out | every
        return out

    hits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        if rule.query():
            hits = hits + F.when(satisfied(rule), F.lit(1 << i).cast("long")).otherwise(0)
    return joined.select("key", hits.alias("hits")).where("hits > 0")


def spans_of(text: Column, rule: SecretRule) -> Column:
    """Array of (s, e, kind) of the rule's matches, left to right, the failing ones dropped."""

    def placed(parts: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(1))
        value = whole if rule.value == 1 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value))

        def body(w: Column) -> Column:
            def walk(v: Column) -> Column:
                start = F.struct(F.array().cast("array<struct<s:int,e:int,kind:string>>").alias("out"), F.lit(0).alias("at"))

                def step(acc: Column, i: Column) -> Column:
                    s = acc["at"] + F.length(F.get(parts, i))
                    e = s + F.length(F.get(w, i))
                    found = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(rule.kind).alias("kind")))
                    good = F.length(F.get(v, i)) >= rule.least
                    return F.struct(F.when(good, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"), e.alias("at"))

                return F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step)["out"]

            empty = F.array().cast("array<struct<s:int,e:int,kind:string>>")
            return F.when(F.size(w) == 0, empty).otherwise(let(value, walk))

        return let(whole, body)

    return let(F.split(text, rule.pattern), placed)


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, text, spans): spans of all rules by start, then by the rules' order."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", row_key("doc_id", "text"))
    found = candidates(postings(rows, rules), rules).withColumnRenamed("key", "_key")
    joined = rows.join(found, F.col("key") == F.col("_key"), "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    none = F.array().cast("array<struct<s:int,e:int,kind:string>>")
    parts = []
    for i, rule in enumerate(rules):
        verify = F.col("text").rlike(rule.pattern)
        if rule.query():
            verify = (F.col("hits").bitwiseAND(F.lit(1 << i).cast("long")) != 0) & verify
        parts.append(F.when(verify, _ranked(spans_of(F.col("text"), rule), i)).otherwise(F.array().cast("array<struct<s:int,r:int,e:int,kind:string>>")))
    return joined.select("doc_id", "text", F.sort_array(F.concat(*parts)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """(doc_id, text) with every found span replaced; overlapping spans become one mask."""

    def cut(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
        return F.struct(F.when(fresh, piece).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"), acc["text"].alias("text"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.col("text").alias("text"))
    done = F.aggregate("spans", start, cut, lambda a: F.concat(a["out"], F.substring(a["text"], a["at"] + 1, F.length(a["text"]))))
    return scan(df, doc_id, text).select("doc_id", done.alias("text"))


def secret_report(df: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base kinds, and all spans."""
    base = [r.kind for r in BASE]
    out = scan(df).withColumn("base", F.filter("spans", lambda x: x["kind"].isin(*base)))
    counts = [_count("base", k).alias(f"n_{k}") for k in base]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
