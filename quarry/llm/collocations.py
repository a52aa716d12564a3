r"""Phrase collocations: two and three words that stand together more often than apart.

Direct-address tiling. Texts are cut at `[.,;:!?\x0A-\x0D]` into pieces and those into words
`[^\x20\x09]+`, A-Z lower-cased; everything is counted per language (a null one is `und`). Words found `min_count`
times or more are numbered by descending frequency, so that the head of the numbers holds most of
the text. A pair (x, y) of neighbours falls into the tile (x // TILE, y // TILE). Tiles
near the origin are groups of their own: a tile with many entries is counted by a dense
bincount over its TILE * TILE cells, one with few by sorted coordinates; pairs farther out
are dealt by hash into buckets of sorted coordinates, their number taken from the number of words.
Frequent pairs are numbered by frequency in turn, and (pair, word) is tiled and counted in the same way.

Texts lie in blocks (see `blocks`) as arrays of numbers. Words get their numbers by a join with the
blocks' dictionaries, pairs by one between the blocks' tiles and the tiles' frequent pairs. A very common
pair is one entry per block. Blocks' entries for one tile are summed in two steps, first
by SALT-many parts, then these, so no task gathers all blocks.

A cut of a phrase behind its first words gives the counts l and r of both sides and the score
floor(10**6 a a / (l r)) for a the phrase's own; the lowest cut counts, the first of equal
ones. Phrases of `min_count` or more are candidates. One that lies in a longer candidate with at least
half its count is dropped. All counts are whole numbers, scores are made in decimals.

Null texts are empty. Each row is a document of its own, also a repeated one. Equal scores are
ranked by count, then by the phrase in UTF-8 order. Other columns do not matter; empty tables and
languages without candidates have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import encode, gather, one_list, pack, pack_pairs, sums, unpack, unpack_pairs
from quarry.llm.store import python_ready, stored
from quarry.llm.words import mix
from quarry.operators.ranking import rank_within_group

MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
TOP_SALTS = 32
BITS = 10
TILE = 1 << BITS
OWN_TILES = 64             # tiles with (i + 1) * (j + 1) up to this are groups of their own
FILL = 16                  # a tile is dense from one entry for so many cells
BUCKET_WORDS = 1 << 22
MOST = 1 << 31             # numbers of words or pairs of one language

MARK = np.zeros(256, bool)
MARK[list(b".,;:!?\n\x0b\x0c\r")] = True
NOT_WORD = MARK.copy()
NOT_WORD[list(b" \t")] = True

_BLOCK = "block bigint, lang string, n bigint, words array<string>, counts array<bigint>, codes binary"
_IDS = "block bigint, lang string, buckets bigint, ids binary"
_TILES = "block bigint, lang string, tile bigint, salt int, keys binary, n binary"
_PAIRS = "lang string, tile bigint, x bigint, y bigint, n bigint"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and language: its words, their counts, and the texts as their numbers, -1 between pieces."""
    for block, rows in gather(batches, "text"):
        langs = rows.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            codes, words, _, cut = encode(rows.filter(pc.equal(langs.indices, k)).column("text"), NOT_WORD, MARK)
            if not len(codes):
                continue
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "lang": [lang], "n": pa.array([len(codes)], pa.int64()),
                "words": one_list(words), "counts": one_list(pa.array(np.bincount(codes, minlength=len(words)), pa.int64())),
                "codes": [pack(np.insert(codes, np.flatnonzero(cut) + 1, -1))]})


def _numbered(block: pa.Table, ids: pa.Table) -> pa.Table:
    """A block's text as numbers by frequency; -1 for rarer words and between pieces."""
    codes = unpack(block.column("codes")[0].as_py()) if block.num_rows and ids.num_rows else np.empty(0, np.int32)
    table = np.full(int(codes.max(initial=0)) + 2, -1, np.int64)           # the last answers for -1
    if len(codes):
        table[ids.column("code").to_numpy()] = ids.column("id").to_numpy()
    keep = block.num_rows if len(codes) else 0
    return pa.table({"block": block.column("block").slice(0, keep), "lang": block.column("lang").slice(0, keep),
                     "buckets": block.column("buckets").slice(0, keep), "ids": pa.array([pack(table[codes])] * keep, pa.binary())})


def _tile_rows(block: int, lang: str, keys: np.ndarray, n: np.ndarray, buckets: int, salts: int) -> pa.RecordBatch:
    """A block's sorted pairs (x << 32 | y) by tile; buckets of far pairs have negative numbers."""
    tx, ty = keys >> (32 + BITS), (keys & 0xFFFFFFFF) >> BITS
    far = -1 - (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    tile = np.where((tx + 1) * (ty + 1) <= OWN_TILES, tx << 32 | ty, far)
    order = np.argsort(tile, kind="stable")
    tile, keys, n = tile[order], keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(tile))
    salt = int(mix(np.array([block], np.int64).view(np.uint64))[0] % np.uint64(salts))
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block] * len(at), pa.int64()), "lang": pa.array([lang] * len(at), pa.string()), "tile": pa.array(tile[at], pa.int64()),
        "salt": pa.array([salt if t >= 0 else 0 for t in tile[at].tolist()], pa.int32()),
        "keys": pa.array([pack_pairs(keys[a:b]) for a, b in zip(at, ends)], pa.binary()),
        "n": pa.array([pack(n[a:b], 8) for a, b in zip(at, ends)], pa.binary())})


class Tile:
    """Sums of the pairs of one tile: sorted coordinates, and a dense array once there are many."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held, self.dense, self.base = 0, None, 0

    def add(self, keys: np.ndarray, n: np.ndarray, own: bool) -> None:
        self.keys.append(keys)
        self.n.append(n)
        self.held += len(keys)
        if self.held >= TILE * TILE:
            if own:
                self.fold()
            else:
                k, _, n = sums(np.concatenate(self.keys), np.concatenate(self.n))
                self.keys, self.n, self.held = [k], [n], 0         # what more comes counts anew

    def fold(self) -> None:
        keys, n = np.concatenate(self.keys), np.concatenate(self.n)
        cells = (keys >> 32 & TILE - 1) << BITS | keys & TILE - 1
        self.base = int(keys[0]) & ~((TILE - 1) << 32 | TILE - 1)
        # below 2**53 the float sums are exact
        count = np.bincount(cells, weights=n, minlength=TILE * TILE).astype(np.int64)
        self.dense = count if self.dense is None else self.dense + count
        self.keys, self.n, self.held = [], [], 0

    def result(self, own: bool) -> tuple[np.ndarray, np.ndarray]:
        if own and self.keys and (self.dense is not None or self.held * FILL >= TILE * TILE):
            self.fold()
        if self.dense is None:
            keys, _, n = sums(np.concatenate(self.keys), np.concatenate(self.n))
            return keys, n
        cells = np.flatnonzero(self.dense)
        return self.base + ((cells >> BITS) << 32 | cells & TILE - 1), self.dense[cells]


def _summed(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    total, tile = Tile(), 0
    for batch in batches:
        for t, keys, n in zip(*(batch.column(c).to_pylist() for c in ("tile", "keys", "n"))):
            tile = t
            total.add(unpack_pairs(keys), unpack(n, 8), t >= 0)
    return tile, *total.result(tile >= 0)


def _part(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile, keys, n = _summed(batches)
    yield pa.RecordBatch.from_pydict({"lang": pa.array([key[0].as_py()], pa.string()), "tile": pa.array([tile], pa.int64()),
                                      "keys": pa.array([pack_pairs(keys)], pa.binary()), "n": pa.array([pack(n, 8)], pa.binary())})


def frequent_pairs(tiles: DataFrame, min_count: int, salts: int) -> DataFrame:
    """(lang, tile, x, y, n): pairs of `min_count` or more, from the blocks' tiles."""
    def whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, keys, n = _summed(batches)
        keys, n = keys[n >= min_count], n[n >= min_count]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([key[0].as_py()] * len(keys), pa.string()), "tile": pa.array(np.full(len(keys), tile), pa.int64()),
            "x": pa.array(keys >> 32, pa.int64()), "y": pa.array(keys & 0xFFFFFFFF, pa.int64()), "n": pa.array(n, pa.int64())})
    parts = tiles.select("lang", "tile", "salt", "keys", "n")
    if salts > 1:
        parts = parts.groupBy("lang", "tile", "salt").applyInArrow(_part, "lang string, tile bigint, keys binary, n binary")
    return parts.drop("salt").groupBy("lang", "tile").applyInArrow(whole, _PAIRS)


def _paired(ids: np.ndarray) -> np.ndarray:
    """Key of the pair that starts at each place but the last; -1 where there is none."""
    x, y = ids[:-1], ids[1:]
    return np.where((x >= 0) & (y >= 0), x << 32 | y, -1)


def _looked_up(tiles: pa.Table, pairs: pa.Table) -> pa.Table:
    """The numbers of the frequent pairs in each block's part of a tile."""
    keys = (pairs.column("x").to_numpy() << 32 | pairs.column("y").to_numpy()) if pairs.num_rows else np.empty(0, np.int64)
    order = np.argsort(keys)
    keys, ids = keys[order], pairs.column("id").to_numpy()[order] if pairs.num_rows else keys
    blocks, langs, found, numbers = [], [], [], []
    for row in tiles.to_pylist() if len(keys) else ():
        mine = unpack_pairs(row["keys"])
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        hit = keys[at] == mine
        if hit.any():
            blocks.append(row["block"]), langs.append(row["lang"])
            found.append(pack_pairs(mine[hit])), numbers.append(pack(ids[at[hit]]))
    return pa.table({"in_block": pa.array(blocks, pa.int64()), "in_lang": pa.array(langs, pa.string()),
                     "keys": pa.array(found, pa.binary()), "numbers": pa.array(numbers, pa.binary())})


def _ranked(df: DataFrame, n: str, *by: str) -> DataFrame:
    """`id` of the rows by descending `n` within a language, from 0."""
    placed = rank_within_group(df.select("lang", (-F.col(n)).alias("less"), *by), "lang", ["less", *by])
    number = F.col("step") - 1
    return placed.select("lang", *by, (-F.col("less")).alias(n), F.when(number < MOST, number).otherwise(
        F.raise_error(F.lit("more frequent words or pairs of one language than can be numbered"))).alias("id"))


def counted(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, ...]:
    """Tables of frequent words (lang, word, f, id), pairs (lang, x, y, n, id) and triples (lang, x, y, n; x a pair),
    and the words of each language (lang, n)."""
    spark = docs.sparkSession
    python_ready(spark)
    blocks = stored(docs.select("lang", "text").mapInArrow(_encoded, _BLOCK), "blocks")
    salts = max(1, math.isqrt(blocks.select("block").distinct().count()))
    lang_n = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    found = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")) \
        .agg(F.sum("w.counts").alias("f")).filter(F.col("f") >= min_count)
    words = stored(_ranked(found, "f", "word"), "words")

    held = blocks.select("block", "lang", F.posexplode("words").alias("code", "word")).join(words, ["lang", "word"]) \
        .select(F.col("block").alias("in_block"), F.col("lang").alias("in_lang"), "code", "id")
    sized = blocks.select("block", "lang", "codes").join(
        lang_n.select("lang", F.ceil(F.col("n") / BUCKET_WORDS).alias("buckets")), "lang")
    ids = stored(sized.groupBy("block", "lang").cogroup(held.groupBy("in_block", "in_lang")).applyInArrow(_numbered, _IDS), "ids")

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _paired(unpack(row["ids"]).astype(np.int64))
                keys, n = sums(keys[keys >= 0])
                yield _tile_rows(row["block"], row["lang"], keys, n, row["buckets"], salts)
    tiles = stored(ids.mapInArrow(pairs_of, _TILES), "pair-tiles")
    pairs = stored(frequent_pairs(tiles, min_count, salts), "pairs")
    numbered = stored(_ranked(pairs, "n", "tile", "x", "y"), "numbered-pairs")

    spread = numbered.select(F.col("lang").alias("in_lang"), F.col("tile").alias("in_tile"), "x", "y", "id", F.explode(
        F.when(F.col("tile") >= 0, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("in_salt"))
    known = tiles.drop("n").groupBy("lang", "tile", "salt").cogroup(spread.groupBy("in_lang", "in_tile", "in_salt")).applyInArrow(
        _looked_up, "in_block bigint, in_lang string, keys binary, numbers binary")

    def triples_of(block: pa.Table, pairs: pa.Table) -> pa.Table:
        if not block.num_rows or not pairs.num_rows:
            return pa.Table.from_batches([_tile_rows(0, "", np.empty(0, np.int64), np.empty(0, np.int64), 1, 1)])
        row = block.to_pylist()[0]
        seq = unpack(row["ids"]).astype(np.int64)
        keys, numbers = (np.concatenate([get(b) for b in pairs.column(c).to_pylist()]) for c, get in (("keys", unpack_pairs), ("numbers", unpack)))
        order = np.argsort(keys)
        keys, numbers, mine = keys[order], numbers[order], _paired(seq)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        left = np.where(keys[at] == mine, numbers[at], -1).astype(np.int64)
        both = (left[:-1] >= 0) & (left[1:] >= 0)
        keys, n = sums((left[:-1] << 32 | seq[2:])[both])
        return pa.Table.from_batches([_tile_rows(row["block"], row["lang"], keys, n, row["buckets"], salts)])
    three = ids.groupBy("block", "lang").cogroup(known.groupBy("in_block", "in_lang")).applyInArrow(triples_of, _TILES)
    triples = stored(frequent_pairs(three, min_count, salts), "triples")
    return words, numbered, triples, lang_n


def score(a: Column, left: Column, right: Column) -> Column:
    dec = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(10 ** 6).cast("decimal(7,0)") * (dec(a) * dec(a)), dec(left) * dec(right)).cast("bigint")


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words, pairs, triples, lang_n = counted(rows, min_count)

    def word(at: str) -> DataFrame:
        return words.select("lang", F.col("id").alias(at), F.col("word").alias(f"{at}_word"), F.col("f").alias(f"{at}_f"))
    two = pairs.select("lang", "x", "y", F.col("n").alias("a"), F.col("id").alias("pair")).join(word("x"), ["lang", "x"]).join(word("y"), ["lang", "y"])
    three = (triples.select("lang", F.col("x").alias("pair"), F.col("y").alias("z"), F.col("n").alias("a"))
             .join(two.withColumnRenamed("a", "xy"), ["lang", "pair"]).join(word("z"), ["lang", "z"])
             .join(pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("n").alias("yz")), ["lang", "y", "z"]))
    cover = three.select("lang", "a", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")))).alias("p")) \
        .groupBy("lang", "p.x", "p.y").agg(F.max("a").alias("longer"))
    free = two.join(cover, ["lang", "x", "y"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVER_PERCENT * F.col("a")))
    short = free.select("lang", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a", F.col("x_f").alias("l"), F.col("y_f").alias("r"),
                        score(F.col("a"), F.col("x_f"), F.col("y_f")).alias("score"))
    cuts = [F.struct(score(F.col("a"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))
            for k, (l, r) in enumerate([(F.col("x_f"), F.col("yz")), (F.col("xy"), F.col("z_f"))], 1)]
    long = three.select("lang", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), "a", F.least(*cuts).alias("cut")) \
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).orderBy(*best)
    first = short.unionByName(long).withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(lang_n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
