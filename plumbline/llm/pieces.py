"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import KeptChunks, distinct_chunks, small_batches

SPACE, OUTSIDE, CODE_BITS = 0x2581, 0x110000, 21
#: Log weight of a character that has no piece: far below any path of pieces, and needed only where there is none.
FALLBACK = -30.0
STORE = 2_000_000  # edges of lattices that a worker keeps, 25 MB


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """A model's pieces as a trie, and the sampler over its lattices.

    A piece of rank r weighs (r + 2.7)^-sharpness: the model orders its pieces by use, and word frequencies fall
    about so. Higher sharpness samples nearer to the best segmentation.
    """

    def __init__(self, model: str, sharpness: float):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model)
        n = m.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        words: list[tuple[str, int]] = []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                words.append((piece, i))
                self.bytes_of[i] = piece.replace(chr(SPACE), " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so decoding could lose characters")
        # spaces begin pieces and never stand inside: then a lattice falls apart at each run of spaces
        apart = not any(re.search(f"[^{chr(SPACE)}]{chr(SPACE)}|\n", w) for w, _ in words)
        self.apart = apart
        children: dict[int, int] = {}
        piece_at = [-1]
        for word, i in words:
            node = 0
            for c in word:
                key = node << CODE_BITS | ord(c)
                if key not in children:
                    children[key] = len(piece_at)
                    piece_at.append(-1)
                node = children[key]
            piece_at[node] = i
        keys = np.fromiter(children, np.int64, len(children))
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.fromiter(children.values(), np.int64, len(children))[order]
        self.piece_at = np.array(piece_at)
        self.weight = np.zeros(n)
        rank = {i: k for k, (_, i) in enumerate(words)}
        for i, k in rank.items():
            self.weight[i] = -sharpness * np.log(k + 2.7)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.width = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.place = np.cumsum(self.width) - self.width
        self.kept = KeptChunks()
        self.first_edge, self.source, self.piece, self.home, self.size = (np.zeros(0, np.int32) for _ in range(5))
        self.share = np.zeros(0, np.float32)

    def _edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece found in the chunks; characters without one get an edge of their own."""
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        starts, lengths, found = [], [], []
        length = 0
        bare = np.ones(len(codes), bool)
        while len(at):
            key = state << CODE_BITS | codes[at + length]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[slot] == key
            at, state = at[on], self.child[slot[on]]
            length += 1
            piece = self.piece_at[state]
            hit = piece >= 0
            starts.append(at[hit]), lengths.append(np.full(int(hit.sum()), length)), found.append(piece[hit])
            if length == 1:
                bare[at[hit]] = False
            more = at + length < end[at]
            at, state = at[more], state[more]
        lone = np.flatnonzero(bare)
        starts.append(lone), lengths.append(np.ones(len(lone), np.int64)), found.append(-1 - codes[lone])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)

    def _build(self, codes: np.ndarray, size: np.ndarray) -> None:
        """Add the lattices of these chunks to the store: nodes with their incoming edges, and the edges' running shares."""
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size)), size)
        start, length, piece = self._edges(codes, (begin + size)[of])
        # a node before each character, and one after each chunk
        node = start + of[start]
        goal, place = node + length, start - begin[of[start]] + length
        order = np.argsort((place << 40 | goal) if len(codes) < 1 << 22 else place * (2 * len(codes)) + goal, kind="stable")
        node, goal, piece, place = node[order], goal[order], piece[order], place[order]
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], FALLBACK)
        n_nodes = len(codes) + len(size)
        alpha = np.full(n_nodes, -np.inf)
        alpha[begin + np.arange(len(size))] = 0.0
        share = np.empty(len(node))
        heads = np.flatnonzero(np.r_[True, goal[1:] != goal[:-1]])
        many = np.diff(np.r_[heads, len(goal)])
        levels = np.flatnonzero(np.r_[True, place[heads][1:] != place[heads][:-1], True])
        for i, j in zip(levels[:-1], levels[1:], strict=True):  # forward: all nodes at one distance from their chunk's start
            a, b = heads[i], heads[j - 1] + many[j - 1]
            first, width = heads[i:j] - a, many[i:j]
            value = alpha[node[a:b]] + weight[a:b]
            top = np.maximum.reduceat(value, first)
            value = np.exp(value - np.repeat(top, width))
            running = np.cumsum(value)
            running -= np.repeat(running[first] - value[first], width)
            total = running[first + width - 1]
            alpha[goal[a:b][first]] = top + np.log(total)
            share[a:b] = running / np.repeat(total, width)
        share[heads + many - 1] = 2.0  # the last edge of a node takes what is left
        first_edge = np.zeros(n_nodes, np.int64)
        first_edge[goal[heads]] = heads
        base_node, base_edge = len(self.first_edge), len(self.share)
        self.first_edge = np.r_[self.first_edge, (first_edge + base_edge).astype(np.int32)]
        self.share = np.r_[self.share, share.astype(np.float32)]
        self.source = np.r_[self.source, (node + base_node).astype(np.int32)]
        self.piece = np.r_[self.piece, piece.astype(np.int32)]
        self.home = np.r_[self.home, (begin + np.arange(len(size)) + base_node).astype(np.int32)]
        self.size = np.r_[self.size, size.astype(np.int32)]

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts with their leading spaces, starts of the chunks, and the number of chunks of each text.

        A chunk is a word with the spaces before it, a newline, or spaces before a newline or the end.
        """
        codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        stop = np.cumsum(length)
        heads = np.zeros(len(codes), bool)
        if self.apart:
            space, line = codes == 0x20, codes == 0x0A
            heads[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        heads[(stop - length)[length > 0]] = True
        starts = np.flatnonzero(heads)
        counts = np.searchsorted(starts, stop) - np.searchsorted(starts, stop - length)
        return np.where(codes == 0x20, SPACE, np.where(codes == SPACE, OUTSIDE, codes)), starts, counts

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text.

        Every distinct chunk of the texts gets one lattice. Those of chunks that occur twice are kept for later texts,
        up to STORE edges; which ones are kept changes no draw.
        """
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes, starts, counts = self._chunks(texts)
        length = np.diff(np.r_[starts, len(codes)])
        unique, at, kind_of, times = distinct_chunks(codes, starts, length)
        number = self.kept.find(unique, codes, starts[at], length[at])

        def build(new: np.ndarray) -> None:
            number[new] = len(self.size) + np.arange(len(new))
            size = length[at[new]]
            where = np.arange(size.sum()) + np.repeat(starts[at[new]] - np.cumsum(size) + size, size)
            self._build(codes[where], size)

        if len(self.share) < STORE and len(often := np.flatnonzero((number < 0) & (times > 1))):
            build(often)
            self.kept.add(unique[often], number[often], codes, starts[at[often]], length[at[often]])
        names = ("first_edge", "share", "source", "piece", "home", "size")
        filled = [getattr(self, x) for x in names]
        if len(rare := np.flatnonzero(number < 0)):
            build(rare)
        try:
            return self._draw(number[kind_of], counts, seeds)
        finally:
            for name, held in zip(names, filled, strict=True):
                setattr(self, name, held)

    def _draw(self, kind: np.ndarray, counts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # backward: every occurrence of a chunk walks from its end to its start, drawing an edge at each node
        row = np.repeat(np.arange(len(counts)), counts)
        ordinal = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = seeds[row] + ordinal.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        home = self.home[kind]
        live, now = np.arange(len(kind)), home + self.size[kind]
        steps, taken = [], np.zeros(len(kind), np.int64)
        while len(live):
            edge, draw = self.first_edge[now], _uniform(key[live], len(steps))
            on = np.flatnonzero(self.share[edge] <= draw)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= draw[on]]
            steps.append((live, self.piece[edge]))
            taken[live] += 1
            now = self.source[edge]
            on = now > home[live]
            live, now = live[on], now[on]
        last = np.cumsum(taken) - 1
        ids = np.empty(int(taken.sum()), np.int64)
        for back, (who, what) in enumerate(steps):
            ids[last[who] - back] = what
        per_text = np.bincount(row, taken, len(counts)).astype(np.int64)
        return self._spelled(ids, per_text)

    def _spelled(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids.astype(np.int32), per_text
        code = -1 - ids[lone]
        code[code == OUTSIDE] = SPACE
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        spread = np.ones(len(ids), np.int64)
        spread[lone] = width
        out = np.repeat(ids, spread)
        at = (np.cumsum(spread) - spread)[lone]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width]
        for k in range(4):
            on = width > k
            bits = code[on] >> (6 * (width[on] - 1 - k))
            out[at[on] + k] = self.byte_id[(bits | lead[on]) if k == 0 else (bits & 0x3F) | 0x80]
        grown = np.bincount(np.repeat(np.arange(len(per_text)), per_text)[lone], width - 1, len(per_text)).astype(np.int64)
        return out.astype(np.int32), per_text + grown

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in one array, and each text's offsets; a text's leading space is left out."""
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        width, at = self.width[ids], self.place[ids]
        width[first] -= 1
        at[first] += 1
        stop = np.r_[0, np.cumsum(width)]
        where = np.arange(stop[-1]) + np.repeat(at - stop[:-1], width)
        return self.flat[where], stop[offsets]


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each key and step: a counter-based generator, so no draw depends on another."""
    z = key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53


@lru_cache(maxsize=2)
def _lattice(model: str, sharpness: float) -> Lattice:
    return Lattice(model, sharpness)


def sample_pieces(docs: DataFrame, seed: str = "pieces", sharpness: float = 1.0, model: str | None = None) -> DataFrame:
    """`docs` without its text, plus ids: a segmentation of the whole text drawn from the posterior of the lattice.

    The draws are a function of seed, doc_id and place in the text, so any partitioning and any retry gives the same
    ids; rows with equal doc_id and text have equal ids, and a null doc_id is a key as well. Null texts have null
    ids, empty ones no ids. A text's first word gets the model's leading space, which decoding takes off again.
    Characters without a piece, the space mark itself among them, become byte pieces. A column named ids is replaced.
    """
    model = model or default_model()
    small_batches(docs.sparkSession, rows=400, megabytes=2)
    names = [c for c in docs.columns if c not in ("text", "ids")]
    rows = docs.select(*names, F.col("text").cast("string").alias("_text"), F.xxhash64(F.lit(seed), "doc_id").alias("_seed"))
    schema = docs.select(*names).withColumn("ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, sharpness)
        for batch in batches:
            texts = batch.column("_text")
            ids, counts = lattice.encode(texts.to_pylist(), batch.column("_seed").to_numpy().view(np.uint64))
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[texts.is_null().to_numpy(zero_copy_only=False), False])
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], [*names, "ids"])

    return rows.mapInArrow(run, schema)


def decode_pieces(coded: DataFrame, model: str | None = None, sharpness: float = 1.0) -> DataFrame:
    """`coded` with text in place of ids, and ids_crc32 (unsigned, little-endian 32-bit ids); null ids have null text."""
    model = model or default_model()
    small_batches(coded.sparkSession, rows=400, megabytes=2)
    names = [c for c in coded.columns if c not in ("ids", "text", "ids_crc32")]
    schema = coded.select(*names, "ids").withColumn("text", F.lit(None).cast("string")).withColumn("ids_crc32", F.lit(None).cast("long")).drop("ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, sharpness)
        for batch in batches:
            lists = batch.column("ids")
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(gone, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            offsets = np.r_[0, np.cumsum(sizes)]
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            raw, stops = lattice.decode(ids, offsets)
            valid = pa.array(~gone).buffers()[1]
            texts = pa.StringArray.from_buffers(len(lists), pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw), valid)
            plain = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            crcs = pa.array([zlib.crc32(plain[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64(), mask=gone)
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "ids"]
            yield pa.RecordBatch.from_arrays([*kept, texts, crcs], [*names, "text", "ids_crc32"])

    return coded.select(*names, "ids").mapInArrow(run, schema)
