"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed place in [0, 2**60) from a hash of its id and source.  A source's budget
becomes a threshold on that place: words are summed by source and the hash's leading bits, the bucket
in which the running sum passes the budget is found, and only that bucket is summed again by the next
bits, until one hash value is left.  No document is sorted; every histogram is pre-aggregated on the
map side, and has at most ``2**BITS`` rows a source.

Defined cases: a null text has size 0, a null source is a source of its own (last), sources of size
0 have target 0; rows that agree in id and source share a hash, and where such a group lies on the
threshold its rows share what is left of the budget in words; an empty table gives an empty result;
other columns pass through, but ``mix`` replaces those named like its own four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, materialize, words_of

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 15, 4


def place(doc_id: Column, source: Column) -> Column:
    """60 bits of an md5 of id and source, as a long."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(source, F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with weight and target: shares by weight of the sum of all sizes, none
    above ``cap`` times its source, the excess reshared by weight.

    With the sources in the order of cap per weight those that reach their cap come first, so one
    pass of running sums tells where the caps end.  The table has a row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("most", cap * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum(F.col("source_size").cast("double")).over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("most").over(by_cap), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)).alias("weight_before"),
    )
    capped = F.col("most") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("most_before"))
    ranked = ranked.withColumn("capped", capped)
    spent = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    used = F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    ranked = ranked.withColumn("spent", spent).withColumn("used", used)
    share = F.col("weight") * (F.col("total") - F.col("spent")) / F.when(F.col("all_weight") > F.col("used"), F.col("all_weight") - F.col("used")).otherwise(1.0)
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(share).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """For each source the hash value at which its budget is reached, what is left of the budget
    there, and the words and rows with that very value."""
    # open_at: leading bits of the place that are settled so far; left: budget beyond all smaller places
    state = goals.select(F.col("source").alias("s"), F.col("part").alias("left"), F.lit(0).cast("long").alias("open_at"))
    for level in range(levels):
        shift = bits * (levels - 1 - level)
        bucket = F.shiftright("place", shift)
        rows = sized.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + bits) == F.col("open_at")))
        sums = rows.groupBy("s", "left", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        run = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        hit = sums.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words")))
        state = hit.select("s", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("open_at"), "words", "n")
        if level < levels - 1:
            state = state.drop("words", "n")
    return state.select("s", F.col("left"), F.col("open_at").alias("at"), "words", "n")


def _mixed(df: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, str]:
    """``df`` and a struct (size, source_size, target, taken), and the struct's name."""
    size = F.size(words_of(F.col(f"`{text}`"))).cast("long")
    at = place(F.col(f"`{doc_id}`"), F.col(f"`{source}`"))
    sized = materialize(df.select(F.col(f"`{source}`").alias("source"), at.alias("place"), size.alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets(sources).withColumn("whole", whole)
    goals = materialize(goals.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cut = thresholds(sized, goals)
    plan = goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = materialize(plan.select("source", "source_size", "target", "whole", "left", "at", "words", "n"), "plan", sized, goals)
    # one struct a side, under a name that no column of the input has
    own, its = free_name(df, "mix"), free_name(df, "plan")
    rows = df.withColumn(own, F.struct(size.alias("size"), at.alias("place"), F.col(f"`{source}`").alias("source")))
    rows = rows.join(plan.select(F.struct(*plan.columns).alias(its)), F.col(f"{own}.source").eqNullSafe(F.col(f"{its}.source")))
    amount, here = F.col(f"{own}.size"), F.col(f"{own}.place")
    p = {c: F.col(f"{its}.{c}") for c in plan.columns}
    tie = F.when(p["n"] == 1, F.when(2 * p["left"] >= p["words"], amount).otherwise(0)).otherwise(F.floor(amount * p["left"] / p["words"]))
    once = F.when(here < p["at"], amount).when(here == p["at"], tie).otherwise(0)
    taken = (p["whole"] * amount + F.coalesce(once, F.lit(0))).cast("long")
    found = F.struct(amount.alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), taken.alias("taken"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(own)), own


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All rows of ``df`` with size, source_size, target and taken added (input columns of these names
    are replaced; ``apply_mix`` keeps them).

    taken = size times the whole part of target / source_size, and once more for the documents
    below the threshold; the document at the threshold is taken if that comes nearer to the target.
    """
    rows, own = _mixed(df, doc_id, text, source)
    names = ("size", "source_size", "target", "taken")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(f"{own}.{n}").alias(n) for n in names])


def apply_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus, with the columns of ``df``: each document as often as it is taken (a part of a
    document counts as one copy if at least half of it is taken)."""
    rows, own = _mixed(df, doc_id, text, source)
    copies = F.when(F.col(f"{own}.size") > 0, F.round(F.col(f"{own}.taken") / F.col(f"{own}.size"))).otherwise(0).cast("int")
    repeated = F.explode(F.when(copies > 0, F.array_repeat(F.lit(True), copies)))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], repeated.alias(own)).drop(own)
