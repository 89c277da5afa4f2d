"""Removal of repeated byte strings by sparse, distributed prefix doubling.

A byte goes if it lies in a ``width``-byte string (400) that also starts anywhere else.  A suffix
array over all bytes would sort each byte position in every round.  Here the first rank is taken at
sampled positions: every window of ``width`` bytes names as its anchor the (last) smallest of the
hashed half-width strings inside it, a function of the window's bytes alone, so equal windows name
equal anchors at equal places.  About one position in a hundred is an anchor.

1. Rank at width/2: anchors are grouped by their half-width string; unique ones, and the windows
   they stand for, drop out.
2. The windows of one anchor follow each other; a run whose whole stretch of bytes occurs elsewhere
   as the run of an equal anchor is repeated throughout, and settled.
3. Rank at width: what is left is unrolled to single window starts, ranked by the pair (rank of the
   anchor, rank of the whole window) and grouped again; of settled runs one representative takes
   part.  Starts that are unique drop out, the others are past the threshold.

All groupings are counts, pre-aggregated on the map side; no group is gathered.  Ranks are 64-bit
hashes, compared within equal anchors only (so 128 bits decide).

Defined cases: null is the empty text; texts shorter than ``width`` lose nothing; repeated rows are
occurrences of their own, and lose all that is long enough; an empty table gives an empty result;
other columns are ignored.  Texts of any length are read in stretches of a megabyte; beside the text
itself a task holds its kept bytes and a few bytes for each of its own.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import materialize, row_key

U = np.uint64
WIDTH = 400


def runs_of(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """Runs of window starts with one anchor: (row, start, end inclusive, anchor hash, stretch hash).
    Starts count bytes within the row."""
    half, n = width // 2, len(raw)
    empty = np.zeros(0, np.int64)
    if n < width:
        return empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    rolling = tn.Rolling(tn.BYTE_VALUES[raw])
    grams = rolling.grams(half)
    anchor = tn.rightmost_minima(grams, width - half + 1)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: n - width + 1]
    inside = np.arange(n - width + 1) + width <= offsets[1:][row]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    first = np.ones(len(at), bool)
    first[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    start = at[first]
    end = np.append(at[np.flatnonzero(first)[1:] - 1], at[-1])
    stretch = tn.mix(rolling.spans(start, end + width) + (anchor[start] - start).astype(U) * U(tn.BASE))
    own = row[start]
    base = offsets[own]
    return own, start - base, end - base, grams[anchor[start]], stretch


def _runs(batches, width: int, limit: int = tn.BLOCK_BYTES):
    """Runs of each text.  A text beyond ``limit`` bytes is read a stretch of window starts at a time;
    a run that a stretch cuts is two, which step 3 compares window by window where need be."""
    for batch in batches:
        raw, offsets = tn.utf8(batch.column("text"))
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for lo, hi in tn.blocks(offsets, limit):
            a, b = int(offsets[lo]), int(offsets[hi])
            for at in range(a, b, limit) if hi == lo + 1 else [a]:
                end = min(b, at + limit + width - 1) if hi == lo + 1 else b
                inner = np.array([at, end]) if hi == lo + 1 else offsets[lo : hi + 1]
                row, start, last, anchor, stretch = runs_of(raw[at:end], inner - at, width)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row + lo]), pa.array((start + at - a if hi == lo + 1 else start).astype(np.int32)), pa.array((last + at - a if hi == lo + 1 else last).astype(np.int32)), pa.array(tn.signed(anchor)), pa.array(tn.signed(stretch))], ["key", "start", "last", "anchor", "stretch"])


def _unrolled(batches, width: int, limit: int = tn.BLOCK_BYTES):
    """(anchor, window, key, start) of all window starts of the open runs of each text, some runs that
    lie close together at a time."""
    for batch in batches:
        raw, offsets = tn.utf8(batch.column("text"))
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        runs = batch.column("open")
        for i in range(batch.num_rows):
            own = runs[i].values
            start, last, anchor = (own.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "last", "anchor"))
            order = np.argsort(start, kind="stable")
            start, last, anchor = start[order], last[order], anchor[order]
            a = 0
            while a < len(start):
                z = min(a + 2000, max(a + 1, int(np.searchsorted(start, start[a] + limit))))
                s, e, h = start[a:z], last[a:z], anchor[a:z]
                base = int(s[0])
                rolling = tn.Rolling(tn.BYTE_VALUES[raw[offsets[i] + base : min(offsets[i + 1], offsets[i] + int(e.max()) + width)]])
                size = e - s + 1
                at = np.repeat(s - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                window = rolling.spans(at - base, at - base + width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, size)), pa.array(tn.signed(window)), pa.array(np.full(len(at), keys[i])), pa.array(at.astype(np.int32))], ["anchor", "window", "key", "start"])
                a = z


def covered_spans(start: np.ndarray, last: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Merged byte spans [a, b) covered by the windows that start in [start, last]."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate(last[order] + width)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    at = np.flatnonzero(new)
    return a[at], np.append(b[at[1:] - 1], b[-1]) if len(at) else b


def _cut(batches, width: int):
    for batch in batches:
        raw, offsets = tn.utf8(batch.column("text"))
        rows: list[tuple] = []
        for i, spans in enumerate(batch.column("spans")):
            text = raw[offsets[i] : offsets[i + 1]]
            n, removed, n_spans = len(text), 0, 0
            if spans.is_valid:
                start, last = (spans.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "last"))
                a, b = covered_spans(start, last, width)
                step = np.zeros(n + 1, np.int8)
                step[a] += 1
                step[b] -= 1
                text = text[np.cumsum(step[:-1], dtype=np.int8) == 0]
                removed, n_spans = n - len(text), len(a)
            rows.append((n, removed, n_spans, text.tobytes()))
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        columns.append(pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def repeated_spans(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, spans): for each row of (key, text) the runs [start, last] of repeated window starts."""
    runs = keyed.select("key", "text").mapInArrow(partial(_runs, width=width), "key long, start int, last int, anchor long, stretch long")
    runs = materialize(runs, "runs")
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    alive = materialize(runs.join(again, "anchor", "left_semi"), "alive", runs)
    kinds = alive.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start")).alias("first"))
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = kinds.join(mixed, "anchor").where("copies > 1 OR kinds > 1")
    ranked = alive.join(kinds, ["anchor", "stretch"])
    is_open = (F.col("kinds") > 1) & ((F.col("copies") == 1) | F.struct("key", "start").eqNullSafe(F.col("first")))
    ranked = materialize(ranked.select("key", "start", "last", "anchor", (F.col("copies") > 1).alias("settled"), is_open.alias("open")), "ranked", alive)
    todo = ranked.where("open").groupBy("key").agg(F.collect_set(F.struct("start", "last", "anchor")).alias("open")).withColumnRenamed("key", "_key")
    texts = keyed.select("key", "text").join(todo, F.col("key") == F.col("_key")).select("key", "text", "open")
    windows = materialize(texts.mapInArrow(partial(_unrolled, width=width), "anchor long, window long, key long, start int"), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    hits = windows.join(twice, ["anchor", "window"], "left_semi").select("key", "start", F.col("start").alias("last"))
    every = ranked.where("settled").select("key", "start", "last").unionByName(hits)
    spans = every.groupBy("key").agg(F.collect_set(F.struct("start", "last")).alias("spans"))
    return materialize(spans, "spans", ranked, windows)


def suffix_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) and kept_sha256."""
    keyed = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", row_key("doc_id", "text"))
    spans = repeated_spans(keyed, width).withColumnRenamed("key", "_key")
    joined = keyed.join(spans, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(partial(_cut, width=width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def suffix_report(df: DataFrame) -> DataFrame:
    return suffix_dedup(df).drop("kept")
