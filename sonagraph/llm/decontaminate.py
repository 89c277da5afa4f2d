"""Benchmark decontamination: documents that hold word windows of test items.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.  The windows
of an item are its runs of ten words (a shorter item is one window).  Their hashes form a sorted table
that is sent to the executors; a document is scanned once, positions whose words all occur in the
benchmark are looked up, and every hit is verified word by word (by the words' 64-bit hashes).

The table is sent only up to ``max_block_bytes`` of benchmark text.  A larger benchmark is dealt into
blocks of items below that size; documents are scanned against each block and the hit words and items
of the blocks are merged by document, so the size of the benchmark doesn't
bound a task's memory; a table takes some 16 bytes for each of its block's text.

Defined cases: null and empty texts have no words; items without words have no window; items that
repeat an item_id count once; a null item_id counts as the item ``null``; repeated documents are
judged alike; empty tables on either side give no hits; other columns pass through ``decontaminate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn

U = np.uint64
WINDOW = 10
MAX_BLOCK_BYTES = 32 << 20
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Table:
    """Sorted windows of a block of items, one group for each window length."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.names = [x for x, _ in items]
        raw, offsets = tn.utf8(pa.array([x for _, x in items], pa.string()))
        words, first, _, _ = tn.spans_of_words(raw, offsets, WORD_BYTE)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(items)):
            a, b = int(first[i]), int(first[i + 1])
            for at in range(a, max(b - width, a) + 1 if b > a else a):
                by_length.setdefault(min(width, b - a), []).append((i, at))
        self.groups = []
        for length, found in sorted(by_length.items()):
            item, at = np.array(found, np.int64).T
            grams = words[at[:, None] + np.arange(length)]
            hashes = tn.shingle_of(grams)
            order = np.argsort(hashes, kind="stable")
            self.groups.append((length, hashes[order], item[order], grams[order]))
        self.known = np.zeros(1 << 16, bool)
        self.known[(words >> U(48)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word covered?, and the pairs row, item) for words of texts (row: text of each word)."""
        covered = np.zeros(len(words) + 1, np.int64)
        rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        run = np.concatenate([[0], np.cumsum(self.known[(words >> U(48)).astype(np.int64)])])
        for length, hashes, item, grams in self.groups:
            n = len(words) - length + 1
            if n <= 0:
                continue
            at = np.flatnonzero((run[length:] - run[:n] == length) & (row[length - 1 :] == row[:n]))
            if not len(at):
                continue
            own = words[at[:, None] + np.arange(length)]
            value = tn.shingle_of(own)
            lo, hi = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
            size = hi - lo
            which = np.repeat(np.arange(len(at)), size)
            entry = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            same = (grams[entry] == own[which]).all(axis=1)
            which, entry = which[same], entry[same]
            begin = np.unique(at[which])
            np.add.at(covered, begin, 1)
            np.add.at(covered, begin + length, -1)
            rows.append(row[at[which]])
            items.append(item[entry])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return np.cumsum(covered[:-1]) > 0, pairs[0], pairs[1]


def _scan_block(table: Table, raw: np.ndarray, offsets: np.ndarray):
    words, first, start, end = tn.spans_of_words(raw, offsets, WORD_BYTE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    covered, rows, items = table.hits(words, row)
    return first, start, end, covered, rows, items


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _scan(table: Table):
    """doc_id, text -> doc_id, key, n_words, hit runs of words, items (ids as strings)."""

    @tn.lean
    def run(batches):
        for batch in batches:
            raw, offsets = tn.utf8(batch.column("text"))
            n_words, spans, names = [], [], []
            for lo, hi in tn.blocks(offsets):
                part = offsets[lo : hi + 1]
                first, _, _, covered, rows, items = _scan_block(table, raw[part[0] : part[-1]], part - part[0])
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    n_words.append(b - a)
                    hit = cut[i + 1] > cut[i]
                    spans.append([x for s, e in zip(*_runs(covered[a:b]), strict=True) for x in (int(s), int(e))] if hit else [])
                    names.append(sorted({table.names[x] for x in items[cut[i] : cut[i + 1]]}) if hit else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "key", "n_words", "spans", "items"])

    return run


_SCHEMA = "doc_id long, key long, n_words long, spans array<long>, items array<string>"


def benchmark_tables(benchmark: DataFrame, item_id: str, text: str, max_block_bytes: int = MAX_BLOCK_BYTES):
    """Tables of the items, each of a bounded number of bytes: items are dealt by hash, and a block
    that is still too large is dealt again.  One very long item may exceed the bound by itself."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-2 * total // max_block_bytes)) if total > max_block_bytes else 1
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i)
        yield Table([(r["item"], r["text"]) for r in part.collect()])


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit (array of word positions start, end, start, end...), items."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    tables = benchmark_tables(benchmark, item_id, item_text, max_block_bytes)
    first = rows.mapInArrow(_scan(next(tables)), _SCHEMA)
    found = None
    for table in tables:
        more = rows.mapInArrow(_scan(table), _SCHEMA).where("size(items) > 0").select("key", "spans", "items").distinct()
        found = more if found is None else found.unionByName(more)
    if found is None:
        return first.drop("key")
    merged = found.groupBy("key").agg(F.collect_list("spans").alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items")).withColumnRenamed("key", "_key")
    joined = first.join(merged, F.col("key") == F.col("_key"), "left").select("doc_id", "n_words", "spans", "items", "more_spans", "more_items")
    return joined.mapInArrow(_merge, "doc_id long, n_words long, spans array<long>, items array<string>")


def _merge(batches):
    for batch in batches:
        spans, items = [], []
        for row in batch.to_pylist():
            mask = np.zeros(row["n_words"], bool)
            for own in [row["spans"], *(row["more_spans"] or [])]:
                for a, b in zip(own[::2], own[1::2], strict=True):
                    mask[a:b] = True
            spans.append([int(x) for pair in zip(*_runs(mask), strict=True) for x in pair])
            items.append(sorted({*row["items"], *(row["more_items"] or [])}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs, benchmark)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, b: a + b)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def _clean(table: Table, text: str, spans: bool):
    @tn.lean
    def run(batches):
        for batch in batches:
            raw, offsets = tn.utf8(batch.column(text))
            keep, texts = np.ones(batch.num_rows, bool), []
            for lo, hi in tn.blocks(offsets):
                part = offsets[lo : hi + 1] - offsets[lo]
                block = raw[offsets[lo] : offsets[hi]]
                first, start, end, covered, rows, _ = _scan_block(table, block, part)
                keep[lo + np.unique(rows)] = False
                if spans:
                    stay = np.ones(len(block) + 1, bool)
                    for i in np.unique(rows):
                        for a, b in zip(*_runs(covered[first[i] : first[i + 1]]), strict=True):
                            stay[start[first[i] + a] : end[first[i] + b - 1]] = False
                    texts += [block[a:b][stay[a:b]].tobytes().decode() for a, b in zip(part[:-1], part[1:], strict=True)]
            if spans:
                old = batch.column(text)
                new = pa.array([x if old[i].is_valid else None for i, x in enumerate(texts)], old.type)
                yield batch.set_column(batch.schema.get_field_index(text), text, new)
            else:
                yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", remove: str = "documents", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window, or (``remove="spans"``) without the hit
    passages, from the first to the last hit word of each; all columns stay."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    for table in benchmark_tables(benchmark, item_id, item_text, max_block_bytes):
        docs = docs.mapInArrow(_clean(table, text, remove == "spans"), docs.schema)
    return docs
