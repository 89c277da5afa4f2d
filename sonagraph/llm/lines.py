"""Line dedup: later occurrences of three consecutive lines go.

The lines of a text that hold a word are numbered; each three neighbours make a window, known by two
64-bit hashes.  Windows are counted over the whole corpus (pre-aggregated on the map side) with their
first place, the smallest (doc_id, text hash, line).  Every other place of a repeated window is covered, covered
lines are merged per document, and removed.

Defined cases: a null text has no lines and comes back null; texts of fewer than three such lines
keep them; lines without a word are never removed; a null doc_id sorts first; rows that agree in
doc_id and text are one occurrence and are treated alike; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, let, materialize, row_key

HAS_WORD = r"[^\x20\x09-\x0D]"
WIDTH = 3


def _worded(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(HAS_WORD))


def _windows(h: Column) -> Column:
    """Each ``WIDTH`` neighbours among hashed lines: their hashes, and their places in the text."""

    def one(i: Column) -> Column:
        part = [F.get(h, i + j) for j in range(WIDTH)]
        places = F.array(*[p["i"] for p in part])
        return F.struct(F.xxhash64(*[p["a"] for p in part]).alias("a"), F.xxhash64(*[p["b"] for p in part]).alias("b"), places.alias("at"))

    return F.when(F.size(h) >= WIDTH, F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), one))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the text replaced by its kept lines, and n_lines and n_removed added."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hashes = F.transform(_worded(F.split("text", "\n")), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("a"), F.xxhash64(s["x"], F.lit("second")).alias("b")))
    placed = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", F.explode(let(hashes, _windows)).alias("w")).select("key", "doc_id", "w.a", "w.b", "w.at")
    placed = materialize(placed, "line-windows")
    here = F.struct("doc_id", "key", F.col("at")[0].alias("line"))
    repeated = placed.groupBy("a", "b").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "first")
    later = placed.join(repeated, ["a", "b"]).where(~here.eqNullSafe(F.col("first")))
    # the texts' key and covered lines stand under names that no column of the input has
    row, its = free_name(df, "row"), free_name(df, "covered")
    covered = later.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("lines")).select(F.struct("key", "lines").alias(its))
    out = df.withColumn(row, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))).join(covered, F.col(row) == F.col(f"{its}.key"), "left")
    gone = F.col(f"{its}.lines")
    body, found = F.col(f"`{text}`"), gone.isNotNull()

    def kept(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone)
        return F.transform(stay, lambda i: F.get(x, i))

    new = F.when(found, F.array_join(let(F.split(body, "\n"), kept), "\n")).otherwise(body)
    n_lines = F.when(body.isNull(), 0).otherwise(F.size(_worded(F.split(body, "\n")))).cast("long")
    removed = F.when(found, F.size(gone)).otherwise(0).cast("long")
    columns = [F.col(f"`{c}`") if c != text else new.alias(text) for c in df.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, n_lines.alias("n_lines"), removed.alias("n_removed"))


def line_report(df: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed and the md5 of the text that stays."""
    out = line_dedup(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
