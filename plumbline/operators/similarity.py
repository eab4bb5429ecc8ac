"""Similar names and quotes: lossless blocking and greedy leader clustering.

Two rows are compared only if they share a block. Blocks come from prefix filters:
of the tokens of a row only the rarest are kept, as many as are needed so that any
two rows above the threshold still share one. Common tokens make no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.ratio import ratios
from plumbline.session import cut_lineage, free


@F.pandas_udf(T.DoubleType())
def seq_ratio(new: pd.Series, old: pd.Series) -> pd.Series:
    """Similarity of two strings, (new, old) in this order: the measure is not symmetric. Null if one of them is."""
    known = (new.notna() & old.notna()).to_numpy()
    out = np.full(len(new), np.nan)
    out[known] = ratios(new[known].tolist(), old[known].tolist())
    return pd.Series(out)


def common_characters(x: Column, y: Column) -> Column:
    """How many characters two strings share, repeats included, in any order."""
    # what is left of y when x's characters, each as often as it stands there, are taken away one by one
    rest = F.aggregate(F.split(x, ""), y, lambda left, c: F.when(
        (c != "") & (F.instr(left, c) > 0), F.concat(F.substr(left, F.lit(1), F.instr(left, c) - 1), F.substr(left, F.instr(left, c) + 1))).otherwise(left))
    return F.length(y) - F.length(rest)


def ratio_above(new: Column, old: Column, threshold: float) -> Column:
    """seq_ratio(new, old) > threshold, with cheap necessary conditions first.

    ratio = 2M/T. M is at most the shorter length, and T - 2M insertions and
    deletions turn one string into the other, so the edit distance is below T(1-t).
    M is at most what is left in common without regard to order.
    """
    total = F.length(new) + F.length(old)
    long_enough = 2 * F.least(F.length(new), F.length(old)) > threshold * total
    near = F.levenshtein(new, old) < total * F.lit(1 - threshold) + F.lit(1e-9)
    worth = F.when(long_enough & near & (new != old), 2 * common_characters(new, old) > threshold * total).otherwise(False)
    # the function sees nulls, and returns at once, where the answer is known
    ratio = seq_ratio(F.when(worth, new), F.when(worth, old))
    return F.coalesce((new == old) | (ratio > threshold), F.lit(False))


# --- blocks ------------------------------------------------------------------------

def grams_of(c: Column, size: int) -> Column:
    """Character n-grams, equal ones included."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
    return F.when(F.length(c) >= size, F.transform(starts, lambda i: F.substr(c, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Distinct words of the text."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def rarest_tokens(rows: DataFrame, scope: Sequence[str], item: str, tokens: Column, keep: Column,
                  numbered: bool = False, order: DataFrame | None = None) -> DataFrame:
    """(scope, item, token, size): the `keep` rarest tokens of each item, by count within the scope.

    size is the number of tokens of the item.
    numbered: the k-th equal token of one item counts as a token of its own.
    order: (token, _n) of an earlier `token_order`, which then decides instead of the counts; new tokens are the rarest.
    """
    scope = list(scope)
    # both lists are made before the explode, once per item and not once per token
    ready = rows.select(*scope, item, keep.alias("_keep"), tokens.alias("_tokens")).filter("_keep > 0")
    flat = ready.select(*scope, item, "_keep", F.explode("_tokens").alias("token"))
    if numbered:
        times = flat.groupBy(*scope, item, "_keep", "token").agg(F.count(F.lit(1)).cast("int").alias("_c"))
        flat = times.select(*scope, item, "_keep", "token", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k")).select(
            *scope, item, "_keep", F.concat("token", F.lit("#"), F.col("_k").cast("string")).alias("token"))
    if order is None:
        counted = flat.join(flat.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("_n")), [*scope, "token"])
    else:
        counted = flat.join(order, "token", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    ranked = counted.groupBy(*scope, item, "_keep").agg(
        F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_t"))
    cut = ranked.select(*scope, item, F.size("_t").alias("size"), F.slice("_t", F.lit(1), F.col("_keep")).alias("_t"))
    return cut.select(*scope, item, "size", F.explode("_t.token").alias("token"))


def token_order(names: DataFrame, name: str) -> DataFrame:
    """(token, _n): how often each token of name_blocks stands in these names. A written one keeps blocks of later names comparable."""
    pieces = [names.select(F.monotonically_increasing_id().alias("_i"), F.explode(grams_of(F.col(name), size)).alias("token")) for size in (1, 2)]
    times = pieces[0].unionByName(pieces[1]).groupBy("_i", "token").agg(F.count(F.lit(1)).cast("int").alias("_c"))
    numbered = times.select("token", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("_k"))
    return numbered.groupBy(F.concat("token", F.lit("#"), F.col("_k").cast("string")).alias("token")).agg(F.count(F.lit(1)).alias("_n"))


def _least_partner(n: Column, t: float) -> Column:
    """A length that no partner above the ratio t goes below."""
    return F.floor(n * F.lit(t / (2 - t)) - F.lit(1e-9))


def name_blocks(rows: DataFrame, scope: Sequence[str], item: str, name: str, threshold: float,
                order: DataFrame | None = None) -> DataFrame:
    """Blocks for the string ratio. Names of two calls share blocks as those of one do if both had the same `order`.

    M matched characters leave at least 3M - T - 1 shared bigrams; ratio > t means
    3M > 1.5tT. Pairs with T >= 1/(1.5t - 1) share a bigram of the kept prefix,
    shorter pairs a character of the kept prefix (they share more than tT/2).
    """
    t = threshold
    least_total = 1 / (1.5 * t - 1)
    n = F.length(name)
    total = n + _least_partner(n, t)
    most_total = n + F.floor(n * F.lit((2 - t) / t)) + 1

    wide = F.greatest(total.cast("double"), F.lit(least_total))
    shared = F.greatest(F.floor(wide * F.lit(1.5 * t - 1) - 1 - F.lit(1e-9)) + 1, F.lit(1))
    keep_grams = F.when(most_total >= least_total, F.greatest(n - 1 - shared + 1, F.lit(0))).otherwise(0).cast("int")
    by_gram = rarest_tokens(rows, scope, item, grams_of(F.col(name), 2), keep_grams, True, order)

    common = F.greatest(F.floor(total * F.lit(t / 2) - F.lit(1e-9)) + 1, F.lit(1))
    keep_chars = (n - common + 1).cast("int")
    short = rows.filter((total < least_total) & (n > 0))
    by_char = rarest_tokens(short, scope, item, grams_of(F.col(name), 1), keep_chars, True, order)
    # a name has one bigram less than characters
    return by_gram.withColumns({"token": F.concat(F.lit("g:"), "token"), "size": F.col("size") + 1}).unionByName(
        by_char.withColumn("token", F.concat(F.lit("c:"), "token")))


def name_size_ratio(threshold: float) -> float:
    """Two names above the threshold differ in length by less than this factor."""
    return threshold / (2 - threshold)


#: Words are counted in so many buckets of their hashes for the order of rarity; no result depends on it.
ORDER_BUCKETS = 1 << 20
#: Bits of the parity sketch of a bag, as 64-bit columns.
SKETCH = tuple(f"_s{i}" for i in range(8))
#: Its sketch in proportion to its size, an array of 64-bit words.
WIDE = "_wide"


def _hashes(bag: str) -> Column:
    return F.transform(bag, lambda w: F.xxhash64(w))


def word_order(bags: DataFrame, bag: str) -> np.ndarray:
    """How often the words of each hash bucket occur, as a logarithm in one byte: a table of fixed size."""
    hashes = bags.select(F.explode(_hashes(bag)).alias("_h"))
    counts = hashes.groupBy(F.pmod("_h", F.lit(ORDER_BUCKETS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.toArrow()
    out = np.zeros(ORDER_BUCKETS, np.uint8)
    out[found["b"].to_numpy()] = np.minimum(np.log2(found["n"].to_numpy()) * 8, 255).astype(np.uint8)
    return out


def _wide_sketches(hashes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Parity sketches of 64 bits for each 32 words, rounded up to a power of two, as lists of 64-bit words."""
    longs = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64))
    out = np.zeros(longs.sum(), np.int64)
    place = np.cumsum(longs) - longs
    for n in np.unique(longs).tolist():
        on = np.flatnonzero(longs == n)
        step = max(1, (1 << 22) // (64 * n))
        for low in range(0, len(on), step):  # counters of a few rows at a time
            some = on[low:low + step]
            count = sizes[some]
            at = np.arange(count.sum()) + np.repeat(begin[some] - np.cumsum(count) + count, count)
            bit = np.repeat(np.arange(len(some)), count) * (64 * n) + ((hashes[at] >> 24) & (64 * n - 1))
            odd = (np.bincount(bit, minlength=len(some) * 64 * n) & 1).astype(bool).reshape(len(some), 64 * n)
            out[place[some][:, None] + np.arange(n)] = np.packbits(odd, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(longs)].astype(np.int32)), pa.array(out))


def word_signatures(rows: DataFrame, scope: Sequence[str], item: str, bag: str, order: np.ndarray) -> DataFrame:
    """What shared words / larger word count > 0.8 is told by, a row for each bag with words: (scope, item, size, _tokens, SKETCH, WIDE).

    One of the first n - floor(0.8n) words in the order of rarity is shared. Tokens are hashes of words: equal hashes
    only add candidates. The sketch has a bit for the parity of the words that fall on it, so two sketches differ in
    no more bits than the bags differ in words.
    """
    names = [*scope, item]
    bits = 64 * len(SKETCH)

    def run(batches):
        for batch in batches:
            lists = batch.column("_h")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            ranked = np.lexsort((flat, order[flat & (ORDER_BUCKETS - 1)], row))
            begin = np.cumsum(sizes) - sizes
            keep = sizes - sizes * 4 // 5
            taken = ranked[np.arange(len(flat)) - np.repeat(begin, sizes) < np.repeat(keep, sizes)]
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)].astype(np.int32)), pa.array(flat[taken]))
            odd = np.zeros((len(sizes), bits), bool)
            for low in range(0, len(sizes), 1000):  # counters of a few rows at a time
                some = slice(begin[low], begin[low] + sizes[low:low + 1000].sum())
                n = len(sizes[low:low + 1000])
                at = (row[some] - low) * bits + ((flat[some] >> 24) & (bits - 1))
                odd[low:low + n] = (np.bincount(at, minlength=n * bits) & 1).reshape(n, bits)
            sketch = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sizes.astype(np.int32)), tokens, *(pa.array(sketch[:, i].copy()) for i in range(len(SKETCH))),
                 _wide_sketches(flat, begin, sizes)], names=[*names, "size", "_tokens", *SKETCH, WIDE])

    ready = rows.filter(F.size(bag) > 0).select(*names, _hashes(bag).alias("_h"))
    shape = T.StructType([*(ready.schema[c] for c in names), T.StructField("size", T.IntegerType()),
                          T.StructField("_tokens", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in SKETCH),
                          T.StructField(WIDE, T.ArrayType(T.LongType()))])
    return ready.mapInArrow(run, shape)


def word_blocks(rows: DataFrame, scope: Sequence[str], item: str, bag: str, order: np.ndarray) -> DataFrame:
    """Blocks for shared words / larger word count > 0.8: (scope, item, size, token, SKETCH), a row for each token of word_signatures."""
    return word_signatures(rows, scope, item, bag, order).select(*scope, item, "size", F.explode("_tokens").alias("token"), *SKETCH)


def words_near(new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    """Whether two rows of word_blocks may share over 0.8 of the larger word count, by their sizes and sketches."""
    differ = sum((F.bit_count(new(c).bitwiseXOR(old(c))) for c in SKETCH), F.lit(0))
    return 5 * differ <= 5 * (new("size") + old("size")) - 8 * F.greatest(new("size"), old("size"))


def words_near_wide(new: Callable[[str], Column], old: Callable[[str], Column]) -> Column:
    """words_near by the wide sketches: sizes that near bags may have differ by one step of the sketch at most, and the longer one is folded."""
    n = F.least(F.size(new(WIDE)), F.size(old(WIDE)))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))).otherwise(x)

    bits = F.zip_with(folded(new(WIDE)), folded(old(WIDE)), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    differ = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return 5 * differ <= 5 * (new("size") + old("size")) - 8 * F.greatest(new("size"), old("size"))


def may_match(blocks: DataFrame, scope: Sequence[str], pos: str,
              near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """(scope, pos) of the rows that share a block with a row of another position that is `near`.

    The join looks for one such row, so neither a large block nor a family of copies becomes pairs.
    """
    new, old = blocks, blocks.select(*[F.col(c).alias(f"_o{c}") for c in blocks.columns])
    cond = (F.col(pos) != F.col(f"_o{pos}")) & near(F.col, lambda c: F.col(f"_o{c}"))
    for c in (*scope, "token"):
        cond = cond & (F.col(c) == F.col(f"_o{c}"))
    return new.join(old, cond, "left_semi").select(*scope, pos).distinct()


#: Rows of blocks that are brought together at once: about 100 bytes each on either side.
BLOCK_ROWS = 3_000_000


def signatures_match(signatures: DataFrame, scope: Sequence[str], pos: str) -> DataFrame:
    """(scope, pos) of the rows of word_signatures that `may_match` finds in their blocks, by words_near; a row may come repeatedly.

    The blocks are made in parts by the hash of their token, some BLOCK_ROWS rows in each: a block lies in one part,
    and what one part has shuffled is gone before the next begins. signatures should be a written table.
    """
    rows = signatures.agg(F.sum(F.size("_tokens"))).first()[0] or 0
    parts = max(1, -(-rows // BLOCK_ROWS))
    out = None
    for part in range(parts):
        tokens = F.filter("_tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(parts)) == part) if parts > 1 else F.col("_tokens")
        blocks = signatures.select(*scope, pos, "size", F.explode(tokens).alias("token"), *SKETCH)
        found = cut_lineage(may_match(blocks, scope, pos, words_near), "near")
        out = found if out is None else out.unionByName(found)
    return out


def word_overlap(x: Column, y: Column) -> Column:
    """Shared words over the larger number of words, of two lists of distinct words."""
    return F.when((F.size(x) > 0) & (F.size(y) > 0),
                  F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


# --- greedy leaders ------------------------------------------------------------------

def greedy_leaders(
    items: DataFrame,
    blocks: DataFrame,
    scope: Sequence[str],
    pos: str,
    fields: Sequence[str],
    matches: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    size_ratio: float = 0.0,
    heads: int = 64,
    most_heads: int = 1000,
    near: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    traits: Sequence[str] = (),
    screen: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
    screened: Sequence[str] = (),
) -> DataFrame:
    """(scope, pos, leader): each item joins the earliest leader it matches, else it leads itself.

    Equals the sequential pass in order of `pos`. In each round the first `heads`
    undecided items of every block are compared with each other. An item is decided
    once all undecided items before it that share a block are among those heads:
    if it matches none of them it is a leader. New leaders then take, block by block,
    the later items that match them. So a family of like items costs one comparison
    per item and block, not one per pair. `heads` doubles while a quarter of the compared items are leaders: items of one
    family would be compared with each other in vain, since its few leaders take them. An item that has a leader is
    compared again only with leaders before it.

    matches(new, old) gets two accessors for the columns of the later and the earlier row.
    blocks: scope, token, pos, size. Rows of one block whose sizes differ by more than
    `size_ratio` cannot match and are not compared; no size fits every size.
    near(new, old) gets accessors for `size` and the further columns `traits` of the blocks: what it rules out is not
    compared either. It holds inside the blocks, before any pair is made.
    screen(new, old) gets accessors for the columns `screened` of the items: it rules out pairs before the columns `fields`,
    which may be long, join them.
    """
    scope = list(scope)
    key = [*scope, pos]
    rows = cut_lineage(items.select(*key, *fields, *screened))
    blocks = blocks.select(*scope, "token", pos, F.col("size").cast("int").alias("size"), *traits).dropDuplicates([*scope, "token", pos])
    shared = blocks.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*scope, "token")
    blocks = cut_lineage(blocks.join(shared, [*scope, "token"], "left_semi"))

    def pairs(early: DataFrame, late: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Distinct (old, new) positions with a common block that match."""
        e = early.select(*scope, "token", F.col(pos).alias("_old"), F.col("size").alias("_osize"), *[F.col(c).alias(f"_o{c}") for c in traits])
        l = late.select(*scope, "token", F.col(pos).alias("_new"), F.col("size").alias("_nsize"), *[F.col(c).alias(f"_n{c}") for c in traits], *extra)
        fits = F.least("_osize", "_nsize") > F.lit(size_ratio) * F.greatest("_osize", "_nsize") - F.lit(1e-9)
        cond = (F.col("_old") < F.col("_new")) & (
            F.col("_osize").isNull() | F.col("_nsize").isNull() | fits)
        if near is not None:
            cond = cond & near(lambda c: F.col(f"_n{c}"), lambda c: F.col(f"_o{c}"))
        if extra:
            cond = cond & (F.col("_best").isNull() | (F.col("_old") < F.col("_best")))
        close = e.join(l, [*scope, "token"]).filter(cond).select(*scope, "_old", "_new").distinct()

        def holding(close: DataFrame, columns: Sequence[str], test: Callable) -> DataFrame:
            old = rows.select(*scope, F.col(pos).alias("_old"), F.struct(*columns).alias("_o"))
            new = rows.select(*scope, F.col(pos).alias("_new"), F.struct(*columns).alias("_n"))
            both = close.join(old, [*scope, "_old"]).join(new, [*scope, "_new"])
            return both.filter(test(lambda c: F.col("_n")[c], lambda c: F.col("_o")[c])).select(*scope, "_old", "_new")

        return holding(close if screen is None else holding(close, screened, screen), fields, matches)

    # rows without any block are leaders at once and take no part in the rounds
    with_blocks = blocks.select(*key).distinct()
    alone = rows.join(with_blocks, key, "left_anti").select(*key, F.col(pos).alias("leader"))
    # state: undecided rows have no leader; `_lead` marks rows that are leaders
    state = with_blocks.select(*key, F.lit(None).cast("long").alias("_best"), F.lit(False).alias("_lead"))
    state = cut_lineage(state)
    undecided = F.col("_best").isNull() & ~F.col("_lead")

    while not state.filter(undecided).isEmpty():
        open_rows = state.filter(undecided)
        open_blocks = blocks.join(open_rows.select(*key), key)
        w = Window.partitionBy(*scope, "token").orderBy(pos)
        top = open_blocks.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= heads).drop("_rank")
        needed = open_blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("_blocks"))
        found = top.groupBy(*key).agg(F.count(F.lit(1)).alias("_heads"))
        complete = needed.join(found, key).filter("_blocks = _heads").select(*key)
        ready = top.join(complete, key, "left_semi")
        beaten = pairs(top, ready).select(*scope, F.col("_new").alias(pos), F.lit(True).alias("_beaten")).distinct()
        judged = cut_lineage(complete.join(beaten, key, "left").select(*key, F.col("_beaten").isNull().alias("_now")))
        leaders = judged.filter("_now").select(*key)

        lead_blocks = open_blocks.join(leaders, key)
        first = leaders.groupBy(*scope).agg(F.min(pos).alias("_first"))
        followers = state.filter(~F.col("_lead")).join(leaders, key, "left_anti").join(first, scope).filter(
            (F.col(pos) > F.col("_first")) & (F.col("_best").isNull() | (F.col("_best") > F.col("_first")))).drop("_first")
        later = blocks.join(followers, key)
        won = pairs(lead_blocks, later, extra=["_best"]).groupBy(*scope, F.col("_new").alias(pos)).agg(
            F.min("_old").alias("_won"))
        before, state = state, cut_lineage(
            state.join(leaders.withColumn("_now", F.lit(True)), key, "left")
            .join(won, key, "left")
            .select(*key, F.least("_best", "_won").alias("_best"),
                    (F.col("_lead") | F.coalesce("_now", F.lit(False))).alias("_lead")))
        compared, led = judged.agg(F.count(F.lit(1)), F.count_if("_now")).first()
        free(before, judged)
        if 4 * led >= compared:
            heads = min(heads * 2, most_heads)

    done = state.select(*key, F.when(F.col("_lead"), F.col(pos)).otherwise(F.col("_best")).alias("leader"))
    return done.unionByName(alone)


def earliest_similar(new: DataFrame, existing: DataFrame, scope: Sequence[str], name: str, pos: str,
                     threshold: float) -> DataFrame:
    """For each distinct new name the earliest existing row whose name is similar: (scope, name, pos)."""
    scope = list(scope)
    both = new.select(*scope, F.lower(name).alias(name)).unionByName(
        existing.select(*scope, F.lower(name).alias(name))).filter(F.length(name) > 0).distinct()
    blocks = name_blocks(both, scope, name, name, threshold)
    old = existing.select(*scope, F.lower(name).alias("_old")).filter(F.length("_old") > 0).distinct()
    candidates = (
        blocks.join(new.select(*scope, F.lower(name).alias(name)).distinct(), [*scope, name], "left_semi")
        .join(blocks.withColumnRenamed(name, "_old").join(old, [*scope, "_old"], "left_semi"), [*scope, "token"])
        .select(*scope, name, "_old").distinct()
        .filter(ratio_above(F.col(name), F.col("_old"), threshold))
    )
    first = existing.groupBy(*scope, F.lower(name).alias("_old")).agg(F.min(pos).alias("_first"))
    return candidates.join(first, [*scope, "_old"]).groupBy(*scope, name).agg(F.min("_first").alias(pos))
