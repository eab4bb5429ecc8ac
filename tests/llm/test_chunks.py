"""Distinct stretches by content, also where hashes are equal."""

import numpy as np
import pytest

from plumbline.llm import common, mixing, pieces, tokens
from pyspark.sql import functions as F


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


PAIR = [thue_morse(2048), thue_morse(2048, "b", "a")]


@pytest.mark.parametrize("hashes", [common.chunk_hashes, lambda codes, starts, size: size.astype(np.uint64) % np.uint64(2)])
def test_distinct_chunks_by_content(hashes):
    r = np.random.default_rng(1)
    codes = r.integers(0, 3, 500)
    starts = np.unique(np.r_[0, r.integers(0, 500, 200)])
    size = np.diff(np.r_[starts, 500])
    found, first, group, times = common.distinct_chunks(codes, starts, size, hashes)
    content = [codes[s:s + n].tobytes() for s, n in zip(starts, size, strict=True)]
    assert len(found) == len(first) == len(times) == len(set(content))
    assert [content[k] for k in first[group]] == content
    assert times.tolist() == [content.count(content[k]) for k in first]
    kept = common.KeptChunks()
    half = len(first) // 2
    kept.add(found[:half], np.arange(half), codes, starts[first[:half]], size[first[:half]])
    number = kept.find(found, codes, starts[first], size[first])
    assert all(x in (-1, k) for k, x in enumerate(number.tolist()))
    assert (number >= 0).sum() >= len(set(found[:half].tolist())) - 1 if half else True


def test_chunk_hashes_part_texts_that_fool_polynomials():
    text = "".join(PAIR)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    a, b = common.chunk_hashes(codes, np.array([0, 2048]), np.array([2048, 2048]))
    assert a != b


@pytest.mark.parametrize("hashes", [common.chunk_hashes, lambda codes, starts, size: np.zeros(len(starts), np.uint64)])
def test_tokens_and_pieces_of_colliding_texts(hashes, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(common.distinct_chunks, "__defaults__", (hashes,))
    texts = [*PAIR, "one two two", PAIR[1], "two one 2 's", ""]
    coder, library = tokens.WordCoder(tokens.default_tokenizer()), tokenizers.Tokenizer.from_file(tokens.default_tokenizer())
    lattice = pieces.Lattice(pieces.default_model(), 1.0)
    for _ in range(2):  # the second time kept stretches are found again
        flat, counts = coder.encode(texts, 1)
        ends = np.cumsum(counts)
        assert all(flat[e - c:e - 1].tolist() == library.encode(t, add_special_tokens=False).ids for t, e, c in zip(texts, ends, counts, strict=True))
        ids, counts = lattice.encode(texts, np.arange(len(texts), dtype=np.uint64))
        raw, offsets = lattice.decode(ids, np.r_[0, np.cumsum(counts)])
        assert [raw[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == texts


def test_tokenizer_files_with_other_rules_go_through_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello World's  12345 Äpfel", "", "don't STOP\n\n"]
    flat, counts = tokens.WordCoder(path).encode(texts, 7)
    ends, library = np.cumsum(counts), tokenizers.Tokenizer.from_file(path)
    assert [flat[e - c:e].tolist() for e, c in zip(ends, counts, strict=True)] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in texts]


def test_mixing_keeps_columns_named_like_its_own(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("mix_draws"), F.lit("x").alias("_copy"), F.lit(2).alias("Mix"))
    got = mixing.mix_sources(docs, growth=3.0)
    assert got.columns == ["doc_id", "source", "mix_draws", "Mix", "_copy", "_order"]
    assert got.select("mix_draws", "Mix").distinct().collect() == [(1, 2)] and abs(got.count() - 600) < 120
