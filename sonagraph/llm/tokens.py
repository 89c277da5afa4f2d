"""Token ids in binary shards, compressed with a Re-Pair grammar.

Documents are range-partitioned by doc_id; each partition is cut into shards of a bounded number of
ids.  In a shard, the most frequent pairs of neighbouring symbols become nonterminals, round after
round, until none is frequent enough (or 16 bits are used up); pairs never cross documents.  A shard
holds the rules, the number of ids each expands to, the compressed symbols, and where each document
starts among them, so one document, or a slice of it, is decoded without the others.

Shard layout, little-endian: magic, n_rules, n_symbols, n_docs, n_ids (uint32 each), end id, base id;
rules (2 x uint16), expansion lengths (uint32), symbols (uint16), then for each document its id
(int64), whether it is null (uint8), its first symbol and its number of ids (uint32 each).
The shards lie in a Parquet table in the shared folder: any store Spark can write can hold it.

Encoding uses the tokenizers library's own parts: its splitter and its byte-pair model, called once
for each distinct stretch between spaces that a worker meets (a bounded cache, by two 64-bit hashes).
A space before a non-space always starts a new piece for byte-level splitters, so the stretches can
be encoded apart; texts near an added token's spelling are encoded whole.

A worker's caches are bounded by bytes, and a long text is encoded a stretch at a time; what a task
holds beside follows the ids of a shard, or of the longest single document.

Defined cases: null is the empty text (the end id alone); null ids come first; repeated rows are
written as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .shared import materialize

END_ID = 2
SHARD_IDS = 1_000_000
MIN_COUNT = 32
RULES_PER_ROUND = 8192
#: Bytes that a worker's caches may hold before they start afresh, and what a cached piece costs beside its ids.
CACHE_BYTES, PIECE_BYTES = 96 << 20, 200
#: Bytes of text that are encoded at once, and after which a long text may be cut.
ENCODE_BYTES = 1 << 17
HEAD = struct.Struct("<4s6I")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Text of these characters only can be split by ``re`` as the library's splitter does (its letters,
#: digits and spaces are the same there); all else goes to the library's splitter.  NUL parts stretches.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"[\t-\r -~{_LETTERS}]*").fullmatch
_SPLIT = re.compile(rf"\0|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}\0]+|\s+(?![^\s\0])|\s+").findall

#: Bytes after a space that may begin white space (or a character that is): no cut before these.
_UNSAFE = np.zeros(256, bool)
_UNSAFE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER
_OTHER[128:] = False


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in same]
    return {x: chr(x) for x in same} | {x: chr(256 + i) for i, x in enumerate(other)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        if self.vocabulary >= 1 << 16:
            raise ValueError("the shard format holds 16-bit symbols")
        self.split = self.tokenizer.pre_tokenizer
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        byte_level = type(self.split).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.apart = byte_level and not self.split.add_prefix_space
        self.alphabet = byte_alphabet()
        self.reset()

    def reset(self) -> None:
        # pieces of the splitter, then stretches of text: numbers in two flat stores of ids
        self.pieces: dict[str, int] = {"\0": 0}
        self.piece_ids, self.piece_starts = array("i"), array("q", [0, 0])
        # hashes of the stretches in ascending order, and the number of each
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.checks = array("i"), array("q", [0]), array("Q")

    def held(self) -> int:
        """About the bytes of the caches."""
        pieces = PIECE_BYTES * len(self.pieces) + 4 * len(self.piece_ids) + 8 * len(self.piece_starts)
        return pieces + 12 * len(self.hashes) + 4 * len(self.ids) + 16 * len(self.starts)

    def _add_pieces(self, fresh: list[str], mapped: list[str]) -> None:
        """``mapped``: the pieces in the byte alphabet, which the model reads."""
        tokenize, ids, starts = self.tokenizer.model.tokenize, self.piece_ids, self.piece_starts
        self.pieces.update(zip(fresh, range(len(starts) - 1, len(starts) - 1 + len(fresh)), strict=True))
        for x in mapped:
            ids.extend([t.id for t in tokenize(x)])
            starts.append(len(ids))

    def _store(self, parts: list[str]) -> None:
        """Append the ids of new stretches to the flat store, in order."""
        found: list[str] = []
        whole = "\0".join(parts) + "\0"
        if _PLAIN(whole.replace("\0", " ")) and "\0" not in "".join(parts):
            found = _SPLIT(whole)
        else:
            for part in parts:
                found += _SPLIT(part) if _PLAIN(part) else [_Odd(*x) for x in self.split.pre_tokenize_str(part)]
                found.append("\0")
        fresh = list(set(found).difference(self.pieces))
        easy = [x for x in fresh if type(x) is str]
        if easy:
            self._add_pieces(easy, "\0".join(easy).encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[0]))
        if len(easy) < len(fresh):
            odd = [x for x in fresh if isinstance(x, _Odd)]
            self._add_pieces(odd, [x.mapped for x in odd])
        number = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        ids, size = _gather(np.frombuffer(self.piece_ids, np.int32), np.frombuffer(self.piece_starts, np.int64), number)
        ends = np.cumsum(size)[number == 0]
        base = len(self.ids)
        self.ids.frombytes(ids.tobytes())
        self.starts.frombytes((ends + base).tobytes())

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts (bytes and offsets) in a row, and how many each text has."""
        n, sizes = len(raw), np.diff(offsets)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        if self.held() > CACHE_BYTES:
            self.reset()
        cut = np.zeros(n, bool)
        cut[:-1] = (raw[:-1] == 32) & ~_UNSAFE[raw[1:]]
        # a letter's piece ends with the letters; a lone line break before a letter is its own piece
        letter = _LETTER[raw]
        cut[1:] |= letter[:-1] & _OTHER[raw[1:]]
        cut[2:] |= letter[2:] & (raw[1:-1] == 10) & _OTHER[raw[:-2]] & ~_UNSAFE[raw[:-2]]
        last = offsets[1:][sizes > 0] - 1
        last = last[raw[last] == 32]
        cut[last] = False
        cut[offsets[:-1][sizes > 0]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        rolling = tn.Rolling(tn.BYTE_VALUES[raw])
        kinds, first, which = np.unique(rolling.spans(begin, end), return_index=True, return_inverse=True)
        check = tn.mix(_weigh(raw, begin[first], end[first]))
        number = np.full(len(kinds), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, kinds), len(self.hashes) - 1)
            number = np.where(self.hashes[at] == kinds, self.numbers[at], -1).astype(np.int64)
        known = number >= 0
        if known.any():
            stale = np.frombuffer(self.checks, np.uint64)[number[known]] != check[known]
            if stale.any():  # two stretches with one hash: start afresh without the cache
                self.reset()
                number[:] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            data = raw.tobytes()
            at = len(self.starts) - 1
            self._store([data[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            number[new] = np.arange(at, at + len(new))
            place = np.searchsorted(self.hashes, kinds[new])
            self.hashes = np.insert(self.hashes, place, kinds[new])
            self.numbers = np.insert(self.numbers, place, number[new].astype(np.int32))
            self.checks.frombytes(check[new].tobytes())
        starts = np.frombuffer(self.starts, np.int64)
        ids, size = _gather(np.frombuffer(self.ids, np.int32), starts, number[which])
        total = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, offsets)]
        return ids, np.diff(total)

    def texts(self, raw: np.ndarray, offsets: np.ndarray):
        """Ids of each text in turn.  A text is encoded a bounded stretch at a time, where it has a place
        to cut."""
        for lo, hi in tn.blocks(offsets, ENCODE_BYTES):
            part = offsets[lo : hi + 1]
            block = raw[part[0] : part[-1]]
            data = block.tobytes()
            if self.apart and not any(x in data for x in self.added):
                if hi == lo + 1:
                    cuts = _cuts(block)
                    yield np.concatenate([self.encode(block[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [np.zeros(0, np.int32)])
                    continue
                ids, sizes = self.encode(block, part - part[0])
                ends = np.cumsum(sizes)
                for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    yield ids[a:b].copy()  # not a view: it would hold the block's ids
            else:
                for a, b in zip((part[:-1] - part[0]).tolist(), (part[1:] - part[0]).tolist(), strict=True):
                    yield np.array(self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False).ids, np.int32)


def _cuts(raw: np.ndarray) -> list[int]:
    """Ends of the stretches of a text: after every ``ENCODE_BYTES`` the next space before no space."""
    out = [0]
    while len(raw) - out[-1] > ENCODE_BYTES:
        at, found = out[-1] + ENCODE_BYTES, -1
        while found < 0 and at < len(raw) - 1:
            end = min(at + 4096, len(raw) - 1)
            hit = np.flatnonzero((raw[at:end] == 32) & ~_UNSAFE[raw[at + 1 : end + 1]])
            found = at + int(hit[0]) if len(hit) else -1
            at = end
        if found < 0:
            break
        out.append(found)
    return [*out, len(raw)] if len(raw) else [0]


class _Odd(str):
    """A piece of the library's splitter: in the byte alphabet already, unlike the plain ones."""

    def __new__(cls, mapped: str, span: tuple[int, int]):
        del span
        out = super().__new__(cls, "\0" + mapped)
        out.mapped = mapped
        return out


def _gather(ids: np.ndarray, starts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stored ids of a row of numbers, and how many each has."""
    begin = starts[number]
    size = starts[number + 1] - begin
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(begin - ends + size, size) + np.arange(total)], size


def _weigh(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second hash of spans, from other byte values and powers; guards the cache."""
    size = end - begin
    ends = np.cumsum(size)
    at = np.repeat(begin - ends + size, size) + np.arange(ends[-1])
    inner = at - np.repeat(begin, size)
    values = tn.mix(raw[at].astype(np.uint64) + (inner.astype(np.uint64) << np.uint64(8)))
    return np.add.reduceat(values, ends - size)


def compress(ids: np.ndarray, closed: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ``ids``: (rules, symbols, places): ``closed`` marks ids that no pair may extend
    over to the right; places are the symbols' positions among the ids."""
    seq, shut, place = ids.astype(np.uint32), closed.copy(), np.arange(len(ids), dtype=np.int32 if len(ids) < 1 << 31 else np.int64)
    rules: list[np.ndarray] = []
    n_rules, number = 0, np.empty(1 << 20, np.int32)
    while len(seq) > 1:
        room = min(RULES_PER_ROUND, (1 << 16) - base - n_rules)
        if room <= 0:
            break
        key = (seq[:-1] << np.uint32(16)) | seq[1:]  # symbols have 16 bits
        slot = ((key * np.uint32(0x9E3779B1)) >> np.uint32(12)).astype(np.int64)
        count = np.bincount(slot, minlength=1 << 20)
        np.subtract.at(count, slot[shut[:-1]], 1)
        # the slots of the most frequent pairs, then exact counts of the pairs in these
        cells = np.flatnonzero(count >= min_count)
        if len(cells) > room:
            often = count[cells]
            cells = cells[often > np.partition(often, -room - 1)[-room - 1]]
        frequent = np.zeros(1 << 20, bool)
        frequent[cells] = True
        at = np.flatnonzero(frequent[slot] & ~shut[:-1])
        if not len(at):
            break
        pair = key[at]
        number[cells] = np.arange(len(cells))
        cell = number[slot[at]]
        # one pair of each slot, then the others
        one = np.zeros(len(cells), np.uint32)
        one[cell] = pair
        odd = np.flatnonzero(one[cell] != pair)
        more, back, n_more = np.unique(pair[odd], return_inverse=True, return_counts=True)
        kinds = np.concatenate([one, more])
        n = np.concatenate([np.bincount(cell, minlength=len(cells)) - np.bincount(cell[odd], minlength=len(cells)), n_more])
        best = np.lexsort((kinds, -n))[:room]
        best = best[n[best] >= min_count]
        if not len(best):
            break
        rule = np.full(len(kinds), -1)
        rule[best] = np.arange(len(best))
        chosen = rule[cell]
        chosen[odd] = rule[len(cells) + back]
        hit = chosen >= 0
        at, chosen = at[hit], chosen[hit]
        # of touching pairs (a run of neighbours) every other one is replaced
        head = np.ones(len(at), bool)
        head[1:] = at[1:] != at[:-1] + 1
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        every = np.flatnonzero((since & 1) == 0)
        at, chosen = at[every], chosen[every]
        seq[at] = base + n_rules + chosen
        shut[at] = shut[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        seq, shut, place = seq[stay], shut[stay], place[stay]
        rules.append(np.stack([(kinds[best] >> np.uint32(16)).astype(np.uint16), (kinds[best] & np.uint32(0xFFFF)).astype(np.uint16)], axis=1))
        n_rules += len(best)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), seq.astype(np.uint16), place


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; rules only refer to earlier ones."""
    out = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.astype(np.int64).tolist()):
        out[base + i] = out[a] + out[b]
    return out[base:]


def write_shard(docs: list[tuple[int | None, np.ndarray]], base: int, end_id: int = END_ID) -> bytes:
    """One shard of (doc_id, ids with the end id)."""
    sizes = np.array([len(x) for _, x in docs], np.int64)
    ids = np.concatenate([x for _, x in docs]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    closed = np.zeros(len(ids), bool)
    closed[np.cumsum(sizes) - 1] = True
    rules, symbols, place = compress(ids, closed, base)
    at = np.searchsorted(place, first)
    head = HEAD.pack(b"SGT1", len(rules), len(symbols), len(docs), len(ids), end_id, base)
    null = np.array([d is None for d, _ in docs], np.uint8)
    numbers = np.array([d or 0 for d, _ in docs], "<i8")
    return b"".join([head, rules.astype("<u2").tobytes(), expansion_lengths(rules, base).astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), numbers.tobytes(), null.tobytes(), at.astype("<u4").tobytes(), sizes.astype("<u4").tobytes()])


class Shard:
    """Random access to one shard."""

    def __init__(self, data: bytes):
        magic, n_rules, n_symbols, n_docs, self.n_ids, self.end_id, self.base = HEAD.unpack_from(data)
        if magic != b"SGT1":
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.length = np.ones(self.base + n_rules, np.int64)
        self.length[self.base :] = take("<u4", n_rules)
        self.symbols = take("<u2", n_symbols)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.first, self.sizes = take("<u4", n_docs).astype(np.int64), take("<u4", n_docs).astype(np.int64)

        # all rules written out, each from the two earlier symbols that it stands for
        ends = np.cumsum(self.length)
        self.begin = ends - self.length
        self.flat = np.empty(int(ends[-1]), np.int32)
        self.flat[: self.base] = np.arange(self.base)
        for i, (a, b) in enumerate(self.rules.tolist()):
            at, mid = self.begin[self.base + i], self.begin[self.base + i] + self.length[a]
            self.flat[at:mid] = self.flat[self.begin[a] : self.begin[a] + self.length[a]]
            self.flat[mid : mid + self.length[b]] = self.flat[self.begin[b] : self.begin[b] + self.length[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a stretch of symbols."""
        if not len(symbols):
            return np.zeros(0, np.int32)
        size = self.length[symbols]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[symbols] - ends + size, size) + np.arange(ends[-1])]

    def document(self, i: int) -> np.ndarray:
        end = self.first[i + 1] if i + 1 < len(self.first) else len(self.symbols)
        return self.expand(self.symbols[self.first[i] : end])

    def slice(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of document i; only the symbols that overlap them are expanded."""
        end = self.first[i + 1] if i + 1 < len(self.first) else len(self.symbols)
        own = self.symbols[self.first[i] : end]
        ends = np.cumsum(self.length[own])
        lo = int(np.searchsorted(ends, start, side="right"))
        hi = int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[lo - 1]) if lo else 0
        return self.expand(own[lo:hi])[max(0, start - skipped) : max(0, stop - skipped)]

    def documents(self):
        whole = self.expand(self.symbols)
        ends = np.cumsum(self.sizes)
        for i, d in enumerate(self.doc_ids):
            yield d, whole[ends[i] - self.sizes[i] : ends[i]]


_ENCODERS: dict[str, Encoder] = {}


@tn.lean
def _encode(batches, path: str, end_id: int, shard_ids: int):
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    encoder = _ENCODERS[path]
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, np.ndarray]] = []
    n = 0

    def shard() -> pa.RecordBatch:
        data = write_shard(held, encoder.vocabulary, end_id)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_ids", "data"])

    for batch in batches:
        raw, offsets = tn.utf8(batch.column("text"))
        for doc_id, text_ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(raw, offsets), strict=True):
            ids = np.append(text_ids, np.int32(end_id))
            held.append((doc_id, ids))
            n += len(ids)
            if n >= shard_ids:
                yield shard()
                held, n, number = [], 0, number + 1
    if held:
        yield shard()


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` in ascending doc_id order and write the shard table (part, shard, n_ids, data)
    to the shared folder; ``part`` and ``shard`` ascend with doc_id."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    coded = ordered.mapInArrow(partial(_encode, path=tokenizer or default_tokenizer(), end_id=end_id, shard_ids=shard_ids), "part int, shard int, n_ids long, data binary")
    return materialize(coded, "tokens")


@tn.lean
def _digest(batches):
    for batch in batches:
        for part, start, data in zip(batch.column("part"), batch.column("start"), batch.column("data"), strict=True):
            del part
            at, rows = start.as_py(), []
            for doc_id, ids in Shard(data.as_py()).documents():
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("_part"), before.alias("before"))
    run = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(run), F.lit(0)).alias("inner"))
    starts = starts.join(parts, F.col("part") == F.col("_part")).select(F.col("part").alias("_part"), F.col("shard").alias("_shard"), (F.col("before") + F.col("inner")).alias("start"))
    placed = shards.join(starts, (F.col("part") == F.col("_part")) & (F.col("shard") == F.col("_shard")))
    return placed.select("part", "start", "data").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                docs = list(Shard(data.as_py()).documents())
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([x.astype(np.int32) for _, x in docs], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shards.mapInArrow(run, "doc_id long, ids array<int>")


def token_report(docs: DataFrame) -> DataFrame:
    return read_tokens(write_tokens(docs))
