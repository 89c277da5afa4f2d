"""Exact n-gram Jaccard self-join of documents and the groups it links.

A document is its set of distinct 5-word shingles; two link when 100*|A&B| >= 75*|A|B|.  Equal sets
are one node from the start (a class), so exact copies never meet each other.

1. *Order.*  One pass counts all shingles into a bounded number of hash buckets.  A shingle's token is
   (how far its bucket's count is above the usual, hash): a global order, about rarest first, that
   needs no dictionary.
2. *Tiles.*  A set of n can only reach the threshold with another if they share one of the first
   n - ceil(0.75 n) + 1 tokens of each, so every class lists these.  A tile is the classes of one
   token, ordered by size; partners lie within the same or the next size band (a factor 4/3).  The
   place of the token in both sets bounds the overlap as well.
3. *Stars.*  In each tile a class is compared with the first of its size band only.  These candidates
   pass the hashed bitmaps (below) and an exact intersection, and the verified links are merged to
   components: a group of thousands of near copies costs one link a member, not one a pair.
   Three more rounds pair neighbours in wide tiles, for groups that no first class holds together.
4. *The rest.*  Tiles are read again with the components known, and of those that still hold several
   all classes of different components are paired, so no link that could join two is lost.  In wide
   tiles these rows carry their bitmaps: only pairs that the bound lets through leave the tile.

*Bitmaps.*  A set's tokens are hashed into a bitmap of 2 to 4 bits a token (by size band).  Each bit
set in A and not in B stands for at least one token of A that B lacks, so n_A minus their number
bounds the overlap from above; pairs below the needed overlap go before any array is intersected.

Tokens and classes are known by 64-bit hashes.  Defined cases: null, empty or blank texts have the
empty set, link with nothing, and are their own component; fewer than five words make one shingle;
repeated rows are one class (component is the smallest doc_id); a null doc_id never becomes a
component's id unless all are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .graph import components
from .shared import discard, docs_of, free_name, materialize

U = np.uint64
K = 5
#: Buckets of the shingle counts: about one for so many bytes of text, within these powers of two.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 64, 18, 26
#: Text of one partial table, about: their sums are dealt to as many lanes as each lane then adds.
PART_BYTES = 1 << 24
CHUNK, FULL = 1 << 16, 1 << 15
#: Rounds of paired neighbours in tiles of several classes, before the rest is paired in full.
PROBES, WIDE = 3, 4
HASH_BITS = 57
_OPEN = ["token", "cls", "n", "pos", "comp"]


def shingle_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of column ``text``, empty sets left out."""
    raw, offsets = tn.utf8(batch.column("text"))
    for lo, hi in tn.blocks(offsets):
        part = offsets[lo : hi + 1]
        words, first = tn.word_hashes(raw[part[0] : part[-1]], part - part[0])
        grams = tn.shingles(words, K)
        for i in range(lo, hi):
            a, b = int(first[i - lo]), int(first[i - lo + 1])
            if b - a >= K:
                yield i, np.unique(grams[a : b - K + 1])
            elif b > a:
                yield i, np.array([tn.text_hash(words[a:b])], U)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def tokens(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ordered token of each shingle hash: the class of its bucket, then the hash."""
    bits = len(classes).bit_length() - 1
    out = (classes[_bucket(hashes, bits)].astype(U) << U(HASH_BITS)) | (hashes & U((1 << HASH_BITS) - 1))
    return np.sort(out)


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    """The chunks of a table of 16-bit counts that hold any, compressed."""
    chunks = total.reshape(-1, CHUNK)
    rows = np.flatnonzero(chunks.any(axis=1))
    data = [zlib.compress(chunks[i].astype(np.uint32).tobytes(), 1) for i in rows]
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(data, pa.binary())], ["chunk", "counts"])


@tn.lean
def _count_buckets(batches, bits: int):
    """Counts of a partition's shingles.  The table holds 16 bits a bucket: before one is full, its
    counts are handed on and it starts again, so none is lost."""
    total = np.zeros(1 << bits, np.uint16)
    for batch in batches:
        for _, hashes in shingle_rows(batch):
            buckets = _bucket(hashes, bits)  # in order, as the hashes are
            first = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            at, n = buckets[first], np.diff(np.append(first, len(buckets)))
            for lo in range(0, len(at), FULL):
                own, more = at[lo : lo + FULL], np.minimum(n[lo : lo + FULL], FULL)
                if (total[own] > 65535 - more).any():
                    yield _chunks(total)
                    total[:] = 0
                total[own] += more.astype(np.uint16)
    yield _chunks(total)


def _sum_chunks(tables) -> np.ndarray:
    total = np.zeros(CHUNK, np.uint64)
    for x in tables["counts"]:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def _add_chunks(table: pa.Table) -> pa.Table:
    """The sum of some tables' chunk, and its median."""
    total = _sum_chunks({"counts": table["counts"].to_pylist()})
    first = table.slice(0, 1)
    counts = pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())
    return first.set_column(first.schema.get_field_index("counts"), "counts", counts).append_column("usual", pa.array([float(np.median(total))]))


def _class_bytes(batches, usual: float):
    for batch in batches:
        classes = [zlib.compress(_classes(_sum_chunks({"counts": [x]}), usual).tobytes(), 1) for x in batch.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(classes, pa.binary())], ["chunk", "classes"])


def bucket_classes(docs: DataFrame) -> np.ndarray:
    """A byte for each of a bounded number of buckets (64 MB at most): how far the bucket's count of
    shingles, over all documents, lies above the usual one, in steps of its spread.  The usual count
    is the median of the chunks' medians.  Partial tables are added in two steps: lanes of
    about the square root of their number, then the lanes; the driver gets bytes only."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // BUCKET_BYTES).bit_length()))
    parts = docs.select("text").mapInArrow(partial(_count_buckets, bits=bits), "chunk int, counts binary")
    number = math.isqrt(size // PART_BYTES) + 1
    lanes = parts.withColumn("lane", F.spark_partition_id() % number).groupBy("chunk", "lane").applyInArrow(_add_chunks, "chunk int, counts binary, lane int, usual double")
    summed = materialize(lanes.select("chunk", "counts").groupBy("chunk").applyInArrow(_add_chunks, "chunk int, counts binary, usual double"), "buckets")
    usual = summed.agg(F.percentile("usual", F.lit(0.5))).first()[0] or 0.0
    out = np.zeros(((1 << bits) // CHUNK, CHUNK), np.uint8)
    for row in summed.mapInArrow(partial(_class_bytes, usual=usual), "chunk int, classes binary").toLocalIterator():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["classes"]), np.uint8)
    discard(summed)
    return out.reshape(-1)


def _classes(counts: np.ndarray, usual: float) -> np.ndarray:
    over = np.maximum(counts - usual, 0) / (2 * np.sqrt(usual + 1))
    return np.minimum(63, np.where(over < 4, over, 4 + 4 * np.log2(np.maximum(over, 4) / 4))).astype(np.uint8)


def needed(n, m):
    """Smallest overlap that links sets of n and m: 100 I >= 75 (n + m - I)."""
    return -(-3 * (n + m) // 7)


def prefix_length(n: int) -> int:
    return n - (-(-3 * n // 4)) + 1


def set_key(hashes: np.ndarray) -> int:
    """Identity of a set by its elements and size."""
    total = int(np.sum(tn.mix(hashes + U(0x9E3779B97F4A7C15)), dtype=U)) + len(hashes) * 0xD6E8FEB86659FD93
    return int(tn.mix(np.array([total % (1 << 64)], U)).view(np.int64)[0])


def bitmap(hashes: np.ndarray) -> bytes:
    """2 to 4 bits a token, a power of two of bits, by size band."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    out = np.zeros(bits, bool)
    out[(hashes % U(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _fold(x: np.ndarray, n: int) -> np.ndarray:
    """A longer bitmap folded to n bytes: bit positions are residues, so halves are or-ed."""
    while len(x) > n:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """Upper bound of the overlap of two sets from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = _fold(x, size), _fold(y, size)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


@tn.lean
def _membership(batches):
    """doc_id, key (of the text), cls and n of every document."""
    for batch in batches:
        n, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, hashes in shingle_rows(batch):
            n[i], keys[i] = len(hashes), set_key(hashes)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(keys, mask=n == 0), pa.array(n)], ["doc_id", "key", "cls", "n"])


def _tiles(classes: np.ndarray):
    @tn.lean
    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            held = 0
            for _, hashes in shingle_rows(batch):
                n = len(hashes)
                head = tokens(hashes, classes)[: prefix_length(n)]
                for column, values in zip(out, (head.view(np.int64), np.full(len(head), set_key(hashes)), np.full(len(head), n, np.int32), np.arange(len(head), dtype=np.int32)), strict=True):
                    column.append(values)
                held += len(head)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "cls", "n", "pos"])
                    out, held = [[], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "cls", "n", "pos"])

    return run


@tn.lean
def _star(batches):
    """Rows of tiles with two classes or more, with the class that leads their size band there."""
    for part in tn.runs(batches, "token"):
        token, cls, n, pos = (part[k] for k in ("token", "cls", "n", "pos"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])  # copies of a class are one row
        token, cls, n, pos = token[new], cls[new], n[new], pos[new]
        head = np.ones(len(token), bool)
        head[1:] = token[1:] != token[:-1]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(token)))
        keep = np.repeat(size > 1, size)
        if not keep.any():
            continue
        token, cls, n, pos, head = token[keep], cls[keep], n[keep], pos[keep], head[keep]
        lead = np.arange(len(token))
        # a row too large for its leader leads those after it: few rounds, each a size band
        at = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        while len(at):
            lead_now = np.zeros(len(at), np.int64)
            lead_now[:] = at
            end = np.append(np.flatnonzero(head), len(token))[group[at] + 1]
            nxt = []
            for a, e in zip(at.tolist(), end.tolist(), strict=True):
                far = a + int(np.searchsorted(n[a:e], n[a] * 4 // 3, side="right"))
                lead[a:far] = a
                if far < e:
                    nxt.append(far)
            at = np.array(nxt, np.int64)
        wide = np.repeat(size[size > 1], size[size > 1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cls), pa.array(n), pa.array(pos), pa.array(cls[lead]), pa.array(wide)], ["token", "cls", "n", "pos", "lead", "wide"])


def _beside(token, cls, comp, n, pos, reach: int) -> list[np.ndarray]:
    """Pairs of classes of different components at most ``reach`` rows apart within a tile, that size
    and place don't rule out."""
    found = [np.zeros((2, 0), np.int64)]
    for d in range(1, reach + 1):
        a, b = np.arange(max(0, len(token) - d)), np.arange(max(0, len(token) - d)) + d
        n_a, n_b = n[a].astype(np.int64), n[b].astype(np.int64)
        ok = (token[a] == token[b]) & (comp[a] != comp[b]) & (np.minimum(n_a - pos[a], n_b - pos[b]) >= needed(n_a, n_b))
        found.append(np.stack([np.minimum(cls[a[ok]], cls[b[ok]]), np.maximum(cls[a[ok]], cls[b[ok]])]))
    return found


def _probe(batches, salt: int):
    """Pairs of neighbours in a tile, its classes in the order of a hash: a group's tiles hold much
    the same classes in the same order, so a class meets a few partners, however large the group."""
    for part in tn.runs(batches, "token"):
        early = part["pos"] * 7 <= part["n"]  # a linked pair's first common token lies here
        part = {k: v[early] for k, v in part.items()}
        order = np.lexsort((tn.mix(part["cls"].view(U) + U(salt)), part["token"]))
        yield _pairs(_beside(*(part[k][order] for k in ("token", "cls", "comp", "n", "pos")), reach=2))


def _narrow(batches):
    """All pairs of different components in tiles of less than ``WIDE`` classes."""
    for part in tn.runs(batches, "token"):
        yield _pairs(_beside(*(part[k] for k in ("token", "cls", "comp", "n", "pos")), reach=WIDE - 1))


def _open(batches):
    """The rows of the wide tiles that hold several components."""
    for part in tn.runs(batches, "token"):
        token, comp = part["token"], part["comp"]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(start, len(token)))
        keep = np.repeat(np.minimum.reduceat(comp, start) < np.maximum.reduceat(comp, start), size)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(part[k][keep]) for k in _OPEN], _OPEN)


class Bitmaps:
    """The bitmaps of a tile's rows, which come by size: those of one length follow each other."""

    def __init__(self, rows: list[bytes]):
        self.length = np.array([len(x) for x in rows])
        self.blocks: dict[int, tuple[int, np.ndarray]] = {}
        for size in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == size)
            self.blocks[size] = int(at[0]), np.frombuffer(b"".join(rows[i] for i in at), np.uint64).reshape(len(at), size // 8)

    def bounds(self, i: int, n: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of row i with the later rows j."""
        out = np.zeros(len(j), np.int64)
        size = int(self.length[i])
        first, block = self.blocks[size]
        own = block[i - first]
        for other in np.unique(self.length[j]).tolist():
            at = np.flatnonzero(self.length[j] == other)
            first, block = self.blocks[other]
            there = block[j[at] - first]
            while there.shape[1] > len(own):
                there = there[:, : there.shape[1] // 2] | there[:, there.shape[1] // 2 :]
            only_own = np.bitwise_count(own & ~there).sum(axis=1, dtype=np.int64)
            only_other = np.bitwise_count(there & ~own).sum(axis=1, dtype=np.int64)
            out[at] = np.minimum(n[i] - only_own, n[j[at]] - only_other)
        return out


@tn.lean
def _across(batches):
    """Pairs of classes of different components within a tile, that size, place and bitmaps don't
    rule out."""
    for part in tn.runs(batches, "token"):
        token, cls, comp, pos = (part[k] for k in ("token", "cls", "comp", "pos"))
        n = part["n"].astype(np.int64)
        edges = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
        found: list[np.ndarray] = []
        held = 0
        for a, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            bits, size = Bitmaps(part["bits"][a:e].tolist()), n[a:e]
            for i in range(e - a - 1):
                far = i + 1 + int(np.searchsorted(size[i + 1 :], size[i] * 4 // 3, side="right"))
                j = np.arange(i + 1, far)
                need = needed(size[i], size[j])
                ok = (comp[a + j] != comp[a + i]) & (np.minimum(size[i] - pos[a + i], size[j] - pos[a + j]) >= need)
                j, need = j[ok], need[ok]
                for lo in range(0, len(j), 4096):
                    few = j[lo : lo + 4096]
                    few = few[bits.bounds(i, size, few) >= need[lo : lo + 4096]]
                    if len(few):
                        found.append(np.stack([np.minimum(cls[a + i], cls[a + few]), np.maximum(cls[a + i], cls[a + few])]))
                        held += len(few)
                if held > 100_000:
                    yield _pairs(found)
                    found, held = [], 0
        if held:
            yield _pairs(found)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


@tn.lean
def _sketch(batches):
    """cls, n, bitmap and the sorted set of each document."""
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for i, hashes in shingle_rows(batch):
            cls = batch.column("cls")[i].as_py()
            if cls == set_key(hashes):  # another text may have the same doc_id
                rows.append((cls, len(hashes), bitmap(hashes), hashes.tobytes()))
                held += len(hashes)
            if held > 500_000:
                yield _sketch_batch(rows)
                rows, held = [], 0
        if rows:
            yield _sketch_batch(rows)


def _sketch_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["cls", "n", "bits", "items"])


@tn.lean
def _screen(batches):
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")}
        ok = [bound(x, y, n, m) >= needed(n, m) for x, y, n, m in zip(c["bits_a"], c["bits_b"], c["n_a"], c["n_b"], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


@tn.lean
def _intersect(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("items_a"), batch.column("items_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            ok.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _with_sets(pairs: DataFrame, sets: DataFrame, *names: str) -> DataFrame:
    """Pairs (a, b) with columns of both sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cls").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
    return pairs


def links_of(pairs: DataFrame, sets: DataFrame, label: str, screened: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that link: by bitmap bound, but for those that are ``screened`` already, then by exact
    intersection."""
    pairs = materialize(pairs, f"{label}-pairs")
    near = _with_sets(pairs, sets, "n", "bits").mapInArrow(_screen, "a long, b long")
    near = materialize(near if screened is None else near.unionByName(screened).distinct(), f"{label}-screened", pairs)
    return materialize(_with_sets(near, sets, "items").mapInArrow(_intersect, "a long, b long"), f"{label}-links", near)


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, cls, n) of all documents, and (cls, root) of every class with a link."""
    docs = docs_of(docs, "doc_id", "text")
    classes = bucket_classes(docs)
    members = materialize(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_membership, "doc_id long, key long, cls long, n long"), "members")
    tiles = docs.mapInArrow(_tiles(classes), "token long, cls long, n int, pos int")
    del classes
    sort = ("token", "n", "cls")
    tiles = tiles.repartition("token").sortWithinPartitions(*sort)
    shared_tiles = materialize(tiles.mapInArrow(_star, "token long, cls long, n int, pos int, lead long, wide int"), "tiles")
    # the sets of the classes that share a tile, each from its smallest document
    busy = shared_tiles.select("cls").distinct()
    chosen = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min_by(F.struct("doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("d")).join(busy, "cls", "left_semi")
    chosen = chosen.select("cls", F.col("d.doc_id").alias("_id"))
    one = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "cls")
    sets = materialize(one.mapInArrow(_sketch, "cls long, n long, bits binary, items binary"), "sets")
    if sets.count() > sets.select("cls").distinct().count():  # rows that repeat, doc_id included
        sets = materialize(sets.dropDuplicates(["cls"]), "sets", sets)

    def joined(links: DataFrame, edges: DataFrame | None) -> DataFrame:
        """(node, component) of all links so far: of the new ones and of the components ``edges``."""
        new = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if edges is None:
            return components(new, links)
        return components(edges.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new), links, edges)

    def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
        rows = rows.select("token", "cls", "n", "pos").join(edges.select(F.col("node").alias("cls"), "component"), "cls", "left")
        return rows.withColumn("comp", F.coalesce("component", "cls")).drop("component").repartition("token").sortWithinPartitions(*sort)

    stars = shared_tiles.where("cls <> lead").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
    edges = joined(links_of(stars, sets, "stars"), None)
    for salt in range(PROBES):
        probes = labelled(shared_tiles.where(f"wide >= {WIDE}"), edges).mapInArrow(partial(_probe, salt=salt), "a long, b long").distinct()
        links = links_of(probes, sets, "probes")
        if not links.limit(1).count():
            discard(links)
            break
        edges = joined(links, edges)
    mixed = labelled(shared_tiles.where(f"wide >= {WIDE}"), edges).mapInArrow(_open, "token long, cls long, n int, pos int, comp long")
    mixed = materialize(mixed, "open")
    wide = mixed.join(sets.select("cls", "bits"), "cls").repartition("token").sortWithinPartitions(*sort).mapInArrow(_across, "a long, b long")
    narrow = labelled(shared_tiles.where(f"wide < {WIDE}"), edges).mapInArrow(_narrow, "a long, b long").distinct()
    edges = joined(links_of(narrow, sets, "across", wide), edges)
    discard(mixed, shared_tiles, sets)
    return members, edges.select(F.col("node").alias("cls"), F.col("component").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    members, roots = linked_classes(docs)
    least = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"))
    # ids meet by class first, so a group's copies are one row when its classes meet
    rooted = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups_ = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.select("cls", "root").join(groups_, "root").select("cls", "component_id"), "named")
    rows = members.join(named, "cls", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates, all columns kept: one row of each group stays.

    It is a row of the group's smallest doc_id (null last); of different texts with that id the one
    with the smallest hash, and of rows that repeat id and text any one.  Rows without words are in no
    group and all stay."""
    members, roots = linked_classes(docs)
    worded = members.where("cls IS NOT NULL")
    first = worded.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    best = first.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.key").alias("text_key"))
    often = worded.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    best = best.join(often, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key"))).select("id", "text_key", "n")
    blank = members.where("cls IS NULL").select(F.col("doc_id").alias("id"), F.col("key").alias("text_key"), F.lit(1).cast("long").alias("n")).distinct()
    stay = materialize(best.unionByName(blank), "stay", members)
    its, row = free_name(docs, "stay"), free_name(docs, "row")
    rows = docs.withColumn(row, F.struct(F.col("`doc_id`").alias("id"), F.xxhash64("text").alias("text_key")))
    same = F.col(f"{row}.id").eqNullSafe(F.col(f"{its}.id")) & (F.col(f"{row}.text_key") == F.col(f"{its}.text_key"))
    rows = rows.join(stay.select(F.struct(*stay.columns).alias(its)), same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where(F.col(f"{its}.n") == 1).select(*columns)
    if not stay.where("n > 1").limit(1).count():
        return once
    return once.unionByName(rows.where(F.col(f"{its}.n") > 1).dropDuplicates([row]).select(*columns))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return groups(docs)
