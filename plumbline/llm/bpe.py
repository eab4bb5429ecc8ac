"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import small_batches

LOAD = 2  # keys a bucket of the hash has on average
TRIES, BLOCK = 1 << 16, 64  # displacements of a bucket before another seed is taken, and how many are tried at once
WIDEST = 64  # bytes of the longest pre-tokens that are merged side by side; longer ones have a heap of their own
SIDE_BY_SIDE = 8192
LONG = 1 << 20  # a text of more characters is cut into pre-tokens portion by portion
PORTION = 200_000


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys fill n slots, two array reads find a key's slot.

    A key's 64-bit hash gives a bucket, a start and a stride. Buckets, the fullest first, get the first displacement
    that puts all their keys into free slots; a bucket with one key names its slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // LOAD)
        for self.seed in range(64):
            if self._build(keys):
                return
        raise ValueError("no seed parts the keys: they are not distinct")

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.uint64(max(self.n, 2))
        bucket = hashes % np.uint64(self.buckets)
        return bucket.astype(np.int64), ((hashes >> np.uint64(16)) % n).astype(np.int64), (np.uint64(1) + (hashes >> np.uint64(32)) % (n - np.uint64(1))).astype(np.int64)

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        seed, digest = self.seed, xxhash.xxh3_64_intdigest
        return np.fromiter((digest(k, seed) for k in keys), np.uint64, len(keys))

    def _build(self, keys: list[bytes]) -> bool:
        bucket, start, stride = self._places(self.hashes(keys))
        self.shift = np.zeros(self.buckets, np.int64)
        slots = np.full(self.n, -1)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if self.n else np.zeros(0, np.int64)
        groups = sorted(np.split(order, cuts[1:]), key=len, reverse=True) if self.n else []
        taken = np.zeros(max(self.n, 1), bool)
        alone = []
        for members in groups:
            if len(members) == 1:
                alone.append(members[0])
                continue
            for low in range(0, TRIES, BLOCK):
                put = (start[members] + np.arange(low, low + BLOCK)[:, None] * stride[members]) % self.n
                free = ~taken[put].any(axis=1)
                free[free] = (np.diff(np.sort(put[free], axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    first = int(free.argmax())
                    taken[put[first]] = True
                    slots[members] = put[first]
                    self.shift[bucket[members[0]]] = low + first
                    break
            else:
                return False
        alone = np.array(alone, np.int64)
        slots[alone] = np.flatnonzero(~taken[:self.n])[:len(alone)]
        self.shift[bucket[alone]] = -slots[alone] - 1
        self.key_of = np.argsort(slots)
        return True

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """For each string the number of the only key that it can be."""
        if not self.n or not keys:
            return np.zeros(len(keys), np.int64)
        bucket, start, stride = self._places(self.hashes(keys))
        shift = self.shift[bucket]
        return self.key_of[np.where(shift < 0, -shift - 1, (start + np.maximum(shift, 0) * stride) % self.n)]


def token_joins(ranks: dict[bytes, int]) -> tuple[dict[int, int], int]:
    """(joins, bits): the rank of the token that two tokens make, by the first's rank, shifted by `bits`, and the second's."""
    bits = max(ranks.values(), default=0).bit_length()
    joins = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                joins[left << bits | right] = rank
    return joins, bits


def merge_bytes(raw: bytes, ranks: dict[bytes, int], joins: dict[int, int], bits: int) -> list[int]:
    """Ids of `raw`: of all neighbouring parts that join to a token, the lowest rank joins first, from the left.

    Parts are linked in both directions. A heap entry is the rank of a part's join with the next one, shifted, and
    the part's place; it holds as long as the part still has that join. A single byte without a rank has no id.
    """
    part = [ranks[raw[i:i + 1]] for i in range(len(raw))]
    n, get, push, pop = len(part), joins.get, heapq.heappush, heapq.heappop
    join = [get(a << bits | b, -1) for a, b in zip(part, part[1:], strict=False)]
    join.append(-1)  # the last part has no next one
    shift = n.bit_length()
    place = (1 << shift) - 1
    heap = [rank << shift | i for i, rank in enumerate(join) if rank >= 0]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        entry = pop(heap)
        i, rank = entry & place, entry >> shift
        if join[i] != rank:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        part[i], part[gone], join[gone] = rank, -1, -1
        if end < n:
            before[end] = i
            new = join[i] = get(rank << bits | part[end], -1)
            if new >= 0:
                push(heap, new << shift | i)
        else:
            join[i] = -1
        left = before[i]
        if left >= 0:
            new = join[left] = get(part[left] << bits | rank, -1)
            if new >= 0:
                push(heap, new << shift | left)
    return [x for x in part if x >= 0]


class JoinTable:
    """The same joins for arrays of pairs: an open-addressed table in numpy."""

    def __init__(self, joins: dict[int, int], bits: int):
        self.bits = bits
        size = 1 << max(4, (2 * len(joins)).bit_length())
        self.mask = size - 1
        self.key, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        key, rank = np.fromiter(joins.keys(), np.int64, len(joins)), np.fromiter(joins.values(), np.int64, len(joins))
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[slot] < 0)
            self.key[slot[free]] = key[free]  # of keys for one slot the last one stays
            put = self.key[slot] == key
            self.rank[slot[put]] = rank[put]
            key, rank, slot = key[~put], rank[~put], (slot[~put] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's join, -1 for none or if a part is -1."""
        key = left << self.bits | right  # negative if a part is
        out = np.full(len(key), -1)
        open_ = np.flatnonzero(key >= 0)
        slot = self._slot(key[open_])
        while len(open_):
            found = self.key[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.rank[slot[hit]]
            on = ~hit & (found >= 0)
            open_, slot = open_[on], (slot[on] + 1) & self.mask
        return out


def merge_side_by_side(codes: np.ndarray, start: np.ndarray, size: np.ndarray, single: np.ndarray, table: JoinTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens of like length, one after the other, and how many each has: merge_bytes for all of them in step.

    Every pre-token has linked parts and a heap of its own: a complete binary tree whose leaves are the joins of its
    parts, in their places, and whose inner nodes hold the smaller of their children. The root is the next join of
    each; the three leaves that it changes rise to the root again.
    """
    n, levels = len(start), max(1, int(size.max() - 1).bit_length())
    width = 1 << levels
    kind = np.int32 if table.bits + levels < 31 else np.int64
    none = np.iinfo(kind).max
    inside = np.arange(width + 1)
    places = np.minimum(start[:, None] + inside, len(codes) - 1)
    part = np.where(inside < size[:, None], single[codes[places]], -1)
    tree = np.empty((n, 2 * width), kind)
    rank = table(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank < 0, none, rank << levels | inside[:-1])
    for k in range(levels - 1, -1, -1):
        below = tree[:, 2 << k:4 << k]
        tree[:, 1 << k:2 << k] = np.minimum(below[:, 0::2], below[:, 1::2])
    part, tree = part.ravel(), tree.ravel()
    after, before = np.tile(inside + 1, n), np.tile(inside - 1, n)
    row = np.arange(n)
    while True:
        entry = tree.take(row * (2 * width) + 1)
        on = entry < none
        if not on.all():
            row, entry = row[on], entry[on]
        if not len(row):
            break
        at, root = row * (width + 1), row * (2 * width)
        i, rank = at + (entry & (width - 1)), (entry >> levels).astype(np.int64)
        gone = after.take(i)
        end = after.take(at + gone)
        after[i] = end
        before[at + end] = i - at
        part[i], part[at + gone] = rank, -1
        left = before.take(i)
        ahead = np.flatnonzero(left >= 0)
        left = left.take(ahead)
        new = table(np.r_[rank, part.take(at.take(ahead) + left)], np.r_[part.take(at + end), rank.take(ahead)])
        # the leaves that change: the joined part's, the vanished part's, and the one's before
        base = np.r_[root, root, root.take(ahead)]
        leaf = np.r_[i - at, gone, left]
        join = np.r_[new[:len(row)], np.full(len(row), -1), new[len(row):]]
        tree[base + (width + leaf)] = np.where(join < 0, none, join << levels | leaf)
        node = leaf + width
        for _ in range(levels):
            node >>= 1
            child = base + 2 * node
            tree[base + node] = np.minimum(tree.take(child), tree.take(child + 1))
    left = part >= 0
    return part[left], left.reshape(n, -1).sum(axis=1)


class TwoTierCoder:
    """Encodes and decodes texts with a vocabulary of byte strings, whose place is their id."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str):
        self.tokens, self.ids = tokens, np.array(ids, np.int64)
        self.ranks = dict(zip(tokens, ids, strict=True))
        self.pattern, self.compiled = pattern, None
        self.whole = PerfectHash(tokens)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "ids", "pattern", "whole")}

    def __setstate__(self, state):
        self.__dict__.update(state, compiled=None, ranks=dict(zip(state["tokens"], state["ids"].tolist(), strict=True)))

    def _ready(self) -> None:
        if self.compiled is None:
            self.compiled = regex.compile(self.pattern)
            self.joins = token_joins(self.ranks)
            self.table = JoinTable(*self.joins)
            self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)])
            # for decoding: all tokens' bytes one after the other, and where those of an id are
            self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
            self.width = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
            self.begin = np.cumsum(self.width) - self.width
            self.place_of = np.full(int(self.ids.max(initial=-1)) + 1, -1)
            self.place_of[self.ids] = np.arange(len(self.ids))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.compiled.findall(text)
            return
        found = (m.group() for m in self.compiled.finditer(text))
        while part := list(islice(found, PORTION)):
            yield part

    def _coded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in one array, and how many each has: its own id if it is a token, else its merged bytes'."""
        maybe = self.whole.lookup(pieces)
        tokens = self.tokens
        missed = np.fromiter((not tokens or tokens[at] != raw for raw, at in zip(pieces, maybe.tolist(), strict=True)), bool, len(pieces))
        size, coded = np.ones(len(pieces), np.int64), []
        misses = np.flatnonzero(missed)
        length = np.fromiter((len(pieces[k]) for k in misses.tolist()), np.int64, len(misses))
        codes = np.frombuffer(b"".join([pieces[k] for k in misses.tolist()]), np.uint8)
        if len(codes) and self.single[codes].min() < 0:
            raise ValueError("the vocabulary has no token for a byte of a text")
        start = np.cumsum(length) - length
        for low in range((WIDEST - 1).bit_length()):  # pre-tokens of one width class at a time
            group = np.flatnonzero((length <= 2 << low) & ((length > 1 << low) | (low == 0)))
            for at in range(0, len(group), SIDE_BY_SIDE):
                some = group[at:at + SIDE_BY_SIDE]
                ids, counts = merge_side_by_side(codes, start[some], length[some], self.single, self.table)
                size[misses[some]] = counts
                coded.append((misses[some], ids))
        for k in misses[length > WIDEST].tolist():
            ids = np.array(merge_bytes(pieces[k], self.ranks, *self.joins))
            size[k] = len(ids)
            coded.append((np.array([k]), ids))
        first = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int64)
        if not missed.all():
            flat[first[~missed]] = self.ids[maybe[~missed]]
        for which, ids in coded:
            n = size[which]
            flat[np.repeat(first[which] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return flat, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has. Each distinct pre-token is looked up once."""
        self._ready()
        words, lengths = [], []
        for text in texts:
            lengths.append(0)
            for part in self._pieces(text):
                words.append(pa.array(part, pa.string()))
                lengths[-1] += len(part)
        distinct = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        flat, size = self._coded(distinct.dictionary.cast(pa.binary()).to_pylist())
        first = np.cumsum(size) - size
        word = distinct.indices.to_numpy(zero_copy_only=False)
        sizes = size[word]
        ends = np.cumsum(sizes)
        out = flat[np.repeat(first[word] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.r_[0, ends][np.cumsum(lengths)] if lengths else np.zeros(0, np.int64)
        return out, np.diff(np.r_[0, upto])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists of ids in one array, and each list's offsets."""
        self._ready()
        place = self.place_of[ids]
        width = self.width[place]
        stop = np.r_[0, np.cumsum(width)]
        where = np.repeat(self.begin[place] - stop[:-1], width)
        where += np.arange(stop[-1])
        return self.flat[where], stop[offsets]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def read_coder(path: str, pattern: str) -> TwoTierCoder:
    """The coder of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return TwoTierCoder([base64.b64decode(token) for token, _ in pairs], [int(rank) for _, rank in pairs], pattern)


def encode_bytes(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids (list of int) of every row's whole text.

    The tokens and their hash are made once on the driver and broadcast: their size is that of the vocabulary file,
    whatever the input. Null texts are empty and have no ids; repeated rows have equal results; columns not in
    `keep` are not read, so they may have any name; `ids` itself cannot be kept.
    """
    spark = docs.sparkSession
    small_batches(spark)
    coder = spark.sparkContext.broadcast(read_coder(ranks or default_ranks(), pattern or default_pattern()))
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_bpe_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = coder.value.encode(batch.column(batch.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "ids"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_bytes(coded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """`coded` with raw (binary): the bytes of the tokens in `ids`, joined; null ids give null.

    A column `raw` of the input is replaced.
    """
    spark = coded.sparkSession
    small_batches(spark)
    coder = spark.sparkContext.broadcast(read_coder(ranks or default_ranks(), pattern or default_pattern()))
    rows = coded.drop("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(gone, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            raw, stops = coder.value.decode(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)])
            raws = pa.Array.from_buffers(pa.binary(), len(lists), [pa.array(~gone).buffers()[1], pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*batch.columns, raws], [*batch.schema.names, "raw"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("raw", T.BinaryType())]))
