"""Token ids in ORC: stripes with integer run lengths, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import KeptChunks, distinct_chunks, small_batches
from plumbline.operators.ordered import dense_ranks

KEPT_WORDS = 300_000  # words whose ids a worker keeps, about 10 MB
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]
_NUMBERS = [*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]
BLANK, LETTER, NUMBER, OTHER = range(4)


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class WordCoder:
    """A word tokenizer of the library, called once for each distinct word of a batch.

    The tokenizer lower-cases, cuts a text into runs of letters, single digits, runs of other signs and English
    endings such as 's, drops white space, and codes each piece by itself. Texts of Latin-1 letters, which no
    normalization changes, are cut here, all texts of a batch at once, and the library's model codes the distinct
    pieces; ids of frequent pieces are kept. Texts with other letters or with a special token's name go through
    the library as they are, and so do all texts if the file has other rules than these.
    """

    #: The normalizer and the cutting rule that _pieces stands for, as a tokenizer file states them.
    NORMALIZER = {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    CUTTING = {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.model = self.coder.model
        rules = json.loads(self.coder.to_str())
        self.known_rules = rules["normalizer"] == self.NORMALIZER and rules["pre_tokenizer"] == self.CUTTING
        self.specials = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.kind_of = np.full(256, OTHER)
        for kind, codes in ((BLANK, _BLANKS), (LETTER, _LETTERS), (NUMBER, _NUMBERS)):
            self.kind_of[codes] = kind
        self.lower = np.arange(256)
        for c in [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]:
            self.lower[c] = c + 32
        self.letters = _byte_letters()
        self.kept = KeptChunks()
        self.ids, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the pieces of lower-cased Latin-1 codes."""
        kind = self.kind_of[codes]
        head = kind != BLANK
        head[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        marks = np.flatnonzero(head & (codes == 0x27))
        if len(marks):  # 's 't 'm 'd 're 've 'll
            after = np.r_[codes, 0, 0]
            x, y = after[marks + 1], after[marks + 2]
            one = np.isin(x, [ord(c) for c in "stmd"])
            two = ~one & (((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l"))))
            size = np.where(one, 2, np.where(two, 3, 0))
            marks, size = marks[size > 0], size[size > 0]
            head[marks + 1] = False
            stop = marks + size
            stop = stop[stop < len(codes)]
            head[stop] |= kind[stop] == LETTER
        cuts = np.flatnonzero(head | (kind == BLANK))
        sizes = np.diff(np.r_[cuts, len(codes)])
        on = head[cuts]
        return cuts[on], sizes[on]

    def _code(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in words]
        return np.fromiter(chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64, len(coded))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's with `end_id` after them, and how many each text has."""
        plain = [t if self.known_rules and (t.isascii() or self._latin(t)) else None for t in texts]
        plain = [None if t is None or any(s in t for s in self.specials) else t for t in plain]
        odd = [i for i, t in enumerate(plain) if t is None]
        whole = dict(zip(odd, (e.ids for e in self.coder.encode_batch([texts[i] for i in odd], add_special_tokens=False)), strict=True))
        codes = self.lower[np.frombuffer("\n".join(t or "" for t in plain).encode("latin-1"), np.uint8)]
        starts, sizes = self._pieces(codes)
        unique, at, word, times = distinct_chunks(codes, starts, sizes)
        number = self.kept.find(unique, codes, starts[at], sizes[at])
        new = np.flatnonzero(number < 0)
        new = new[np.argsort(times[new] < 2, kind="stable")]  # those that may be kept come first
        text = codes.astype(np.uint8).tobytes().decode("latin-1")
        begin = starts[at[new]]
        fresh, lengths = self._code([text[a:b] for a, b in zip(begin.tolist(), (begin + sizes[at[new]]).tolist(), strict=True)])
        known = len(self.start) - 1
        number[new] = known + np.arange(len(new))
        ids, first = np.r_[self.ids, fresh], np.r_[self.start, self.start[-1] + np.cumsum(lengths)]
        often = int((times[new] > 1).sum())
        if often and known < KEPT_WORDS:
            self.ids, self.start = ids[:first[known + often]].copy(), first[:known + often + 1].copy()
            keep = new[:often]
            self.kept.add(unique[keep], number[keep], codes, starts[at[keep]], sizes[at[keep]])
        return self._joined(texts, plain, whole, number[word], starts, ids, first, end_id)

    @staticmethod
    def _latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    @staticmethod
    def _joined(texts, plain, whole, word, starts, ids, first, end_id) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(first)[word]
        before = np.r_[0, np.cumsum(size)]
        length = np.fromiter((len(t) if t else 0 for t in plain), np.int64, len(texts))
        stop = np.cumsum(length + 1)  # a newline parts two texts
        upto = np.searchsorted(starts, stop)
        counts = np.diff(np.r_[0, before[upto]]) + 1
        for i, coded in whole.items():
            counts[i] = len(coded) + 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        out[ends - 1] = end_id
        # a word's place: what its text holds before it, from where the text begins
        row = np.searchsorted(upto, np.arange(len(word)), side="right")
        place = before[:-1] - np.r_[0, before[upto]][row] + (ends - counts)[row]
        inside = np.arange(before[-1]) - np.repeat(before[:-1], size)
        out[np.repeat(place, size) + inside] = ids[np.repeat(first[word], size) + inside]
        for i, coded in whole.items():
            out[ends[i] - counts[i]:ends[i] - 1] = coded
        return out, counts


@lru_cache(maxsize=2)
def _coder(path: str) -> WordCoder:
    return WordCoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, parts: int | None = None) -> None:
    """Write doc_id and ids of every row of `docs` as ORC files in ascending doc_id order (nulls first).

    The rows are dealt to `parts` files by ranges of doc_id and sorted there, then encoded; the file names carry
    the order. ORC keeps the ids as run-length coded integers in stripes, with row indexes and a Bloom filter on
    doc_id for each 10 000 rows, so a reader takes stripes in parallel and skips those without its documents. Null
    texts are empty: the end id alone. Rows with equal doc_id stand next to each other by hash of the text.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=1000, megabytes=4)
    tokenizer = tokenizer or default_tokenizer()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_key")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            ids, sizes = coder.encode(batch.column("_text").to_pylist(), end_id)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes)], ["doc_id", "ids", "n_tokens"])

    out = rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option(
        "orc.stripe.size", str(16 << 20)).option("orc.row.index.stride", "10000").option("orc.compress", "ZSTD").orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids and n_tokens from the files; `doc_ids` is pushed down to the row indexes and Bloom filters."""
    out = spark.read.schema("doc_id long, ids array<int>, n_tokens long").orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, start counting all ids of documents before it."""
    small_batches(spark, rows=1000, megabytes=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            plain = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<u4")).cast("B")
            crcs = [zlib.crc32(plain[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())],
                                             ["doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long")
    ranked = dense_ranks(rows, ["doc_id", "ids_crc32"], [], "rank", total=["n_tokens"])
    return ranked.select("doc_id", F.col("before_n_tokens").cast("long").alias("start"), "n_tokens", "ids_crc32")
