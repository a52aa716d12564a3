r"""Source divergence audit: how far each source's use of terms lies from the others' of its language.

Chunk factorization. Texts are cut at white space into chunks, which are counted per
document; a block of documents of one language holds them as numbers into the block's dictionary of
distinct chunks (see `blocks`). Every globally distinct chunk is cut into its terms once,
`[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, A-Z lower-cased. Terms whose chunks have too few documents of a language
together can not be kept there and go. The others are joined back, as numbers, to the blocks
that hold the chunk; a block then gives per (lang, source, term) its occurrences and the
distinct documents (two chunks of one document may share a term). These sums are all that
is shuffled by term. A very common chunk is one row per block, a very common
term one row per block and source, a large source one row per block and term.

A language keeps the terms in at least `min_docs` of its documents. With c occurrences of a kept term
in a group, N the sum of c over kept terms and V their number, p = 1 + floor(10**9 (c + 2) /
(N + 2 V)); two groups differ in a term by floor((p - q)**2 / (p + q)). Pairs of sources are
summed in tiles of terms by blocks of sources: no task holds more than TILE_TERMS terms by
2 * SOURCE_BLOCK sources. All figures are whole numbers; p is made in decimals.

Null text, lang and source are read as ''. Each row is a document of its own, whatever its
other columns say, so repeated rows count as often as they occur. A group without terms has c = 0 throughout;
a language without kept terms gives pairs of value 0 and no terms. An empty table has no rows.
Equal values are ranked by item in UTF-8 order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import encode, gather, one_list, pack, sums, unpack
from quarry.llm.store import python_ready, stored
from quarry.llm.words import WHITE_SPACE

MIN_DOCS = 10
TOP_TERMS = 10
TILE_TERMS = 4096
SOURCE_BLOCK = 256
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK_BYTES = 32 << 20

_BLOCK = ("block bigint, lang string, sources array<string>, doc_source binary, doc_start binary, codes binary, counts binary, "
          "chunks array<string>, docs array<int>")
_COUNT = "lang string, source string, id bigint, n bigint, docs bigint"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block and language: its sources, each document's source and distinct chunks with counts, and the
    dictionary of chunks with the number of documents of each."""
    for block, rows in gather(batches, "text", BLOCK_BYTES):
        langs = rows.column("lang").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = rows.filter(pc.equal(langs.indices, k))
            codes, chunks, words, _ = encode(mine.column("text"), WHITE_SPACE)
            sources, size = mine.column("source").dictionary_encode(), max(1, len(chunks))
            steps, counts, held = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
            n_docs = np.zeros(len(chunks), np.int32)
            for first in range(0, mine.num_rows, 1000):
                ends = words[first:first + 1001]
                doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                found, n = sums(doc * size + codes[ends[0]:ends[-1]])
                doc, code = np.divmod(found, size)
                n_docs += np.bincount(code, minlength=len(chunks)).astype(np.int32)
                starts = np.searchsorted(doc, np.arange(len(ends)))
                step, begin = np.diff(code, prepend=0), starts[:-1][starts[:-1] < len(code)]
                step[begin] = code[begin]
                steps.append(step.astype(np.int32)), counts.append(n.astype(np.int32)), held.append(starts[1:] + held[-1][-1])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "lang": [lang], "sources": [sources.dictionary.to_pylist()],
                "doc_source": [pack(sources.indices.to_numpy(zero_copy_only=False))], "doc_start": [pack(np.concatenate(held))], "codes": [pack(np.concatenate(steps))],
                "counts": [pack(np.concatenate(counts))], "chunks": one_list(chunks), "docs": one_list(pa.array(n_docs))})


def _counted(block: pa.Table, back: pa.Table) -> pa.Table:
    """Occurrences and distinct documents of the terms of a block, by source."""
    if not block.num_rows or not back.num_rows:
        return pa.table({c: pa.array([], pa.string() if c in ("lang", "source") else pa.int64()) for c in ("lang", "source", "id", "n", "docs")})
    row = {c: block.column(c)[0].as_py() for c in ("lang", "sources", "doc_source", "doc_start", "codes", "counts")}
    of_doc, starts, steps, counts = (unpack(row[c]) for c in ("doc_source", "doc_start", "codes", "counts"))
    # numbers were kept as steps from the one before in the same document
    total = np.cumsum(steps, dtype=np.int64)
    begin = starts[:-1]
    before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0) if len(total) else np.zeros(len(begin), np.int64)
    codes = total - np.repeat(before, np.diff(starts))
    lists = back.column("ids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    terms, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    size, first = np.zeros(int(codes.max(initial=0)) + 1, np.int64), np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    at, lengths = back.column("code").to_numpy(), np.diff(lists.offsets.to_numpy())
    size[at], first[at] = lengths, np.cumsum(lengths) - lengths
    found = []
    for d in range(0, len(of_doc), 1000):
        # every (document, chunk) spread over the chunk's terms
        ends = starts[d:d + 1001]
        mine, per = codes[ends[0]:ends[-1]], size[codes[ends[0]:ends[-1]]]
        within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        term = flat[np.repeat(first[mine], per) + within]
        doc = np.repeat(np.repeat(np.arange(d, d + len(ends) - 1), np.diff(ends)), per)
        keys, _, n = sums(doc * len(terms) + term, np.repeat(counts[ends[0]:ends[-1]], per))
        doc, term = np.divmod(keys, len(terms))
        found.append(sums(of_doc[doc].astype(np.int64) * len(terms) + term, n))
    keys, _, docs, n = sums(*(np.concatenate(x) for x in zip(*found)))
    source, term = np.divmod(keys, len(terms))
    return pa.table({"lang": pa.array([row["lang"]] * len(keys), pa.string()), "source": pa.array(row["sources"], pa.string()).take(pa.array(source)),
                     "id": pa.array(terms[term], pa.int64()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n): occurrences per group and language of the terms that a language keeps."""
    python_ready(docs.sparkSession)
    blocks = stored(docs.mapInArrow(_encoded, _BLOCK), "blocks")
    chunks = blocks.select("lang", F.explode(F.arrays_zip("chunks", "docs")).alias("c")).groupBy("lang", F.col("c.chunks").alias("chunk")).agg(F.sum("c.docs").alias("docs"))
    cut = stored(chunks.groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))
                 .select("chunk", "langs", F.filter(F.split("chunk", NOT_TERM), lambda t: t != "").alias("terms")).filter(F.size("terms") > 0), "chunks")
    # a term has at most as many documents as its chunks together
    some = cut.select(F.explode("langs").alias("l"), "terms").select("l.lang", "l.docs", F.explode(F.array_distinct("terms")).alias("term")) \
        .groupBy("lang", "term").agg(F.sum("docs").alias("most")).filter(F.col("most") >= min_docs)
    some = stored(some.select("lang", "term").withColumn("id", F.monotonically_increasing_id()), "terms")

    numbers = cut.select("chunk", F.explode("langs").alias("l"), "terms").select("chunk", "l.lang", F.explode("terms").alias("term")) \
        .join(some, ["lang", "term"]).groupBy("lang", "chunk").agg(F.collect_list("id").alias("ids"))
    held = blocks.select("block", "lang", F.posexplode("chunks").alias("code", "chunk"))
    back = held.join(numbers, ["lang", "chunk"]).select(F.col("block").alias("in_block"), F.col("lang").alias("in_lang"), "code", "ids")
    per_block = blocks.drop("chunks", "docs").groupBy("block", "lang").cogroup(back.groupBy("in_block", "in_lang")).applyInArrow(_counted, _COUNT)
    counts = stored(per_block.groupBy("lang", "source", "id").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "id").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    return counts.select("lang", "source", "id", "n").join(kept.join(some, ["lang", "id"]).select("lang", "id", "term", "lang_n"), ["lang", "id"]) \
        .select("lang", "source", "term", "n", "lang_n")


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term with `n` of `total` occurrences among `kept` terms; null where none is kept."""
    dec = lambda c, d: c.cast(f"decimal({d},0)")
    top = dec(F.lit(10 ** 9), 10) * dec(n + 2, 19)
    return F.when(kept > 0, 1 + F.call_function("div", top, dec(total + 2 * kept, 19))).cast("bigint")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tile_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of gaps over one tile of terms for the sources of two blocks of sources (`right`: the sources, `left`: their shares)."""
    out: dict[str, list] = {"lang": [], "source": [], "item": [], "value": []}
    lang, i, j, n_terms = (right.column(c)[0].as_py() for c in ("lang", "i", "j", "v"))
    side, names, zero = right.column("b").to_numpy(), right.column("source").to_pylist(), right.column("p0").fill_null(0).to_numpy()
    place = {s: k for k, s in enumerate(names)}
    coded = left.column("term").combine_chunks().dictionary_encode() if left.num_rows else None
    seen = len(coded.dictionary) if coded is not None else 0
    p = np.repeat(zero[:, None], seen, axis=1)
    if seen:
        p[[place[s] for s in left.column("source").to_pylist()], coded.indices.to_numpy(zero_copy_only=False)] = left.column("p").to_numpy()
    a_rows, b_rows = np.flatnonzero(side == i), np.flatnonzero(side == j)
    pb, zb = p[b_rows], zero[b_rows]

    def f(x, y):
        return (x - y) ** 2 // np.maximum(1, x + y)
    for a in a_rows:
        value = f(p[a][None, :], pb).sum(axis=1) + (n_terms - seen) * f(zero[a], zb)
        for b, v in zip(b_rows, value):
            if a != b:
                out["lang"].append(lang), out["source"].append(names[a]), out["item"].append(names[b]), out["value"].append(int(v))
                if i != j:
                    out["lang"].append(lang), out["source"].append(names[b]), out["item"].append(names[a]), out["value"].append(int(v))
    return pa.table({c: pa.array(v, pa.int64() if c == "value" else pa.string()) for c, v in out.items()})


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
          top: int = TOP_TERMS, tile_terms: int = TILE_TERMS, source_block: int = SOURCE_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by
    their distance, part `term` the group's `top` terms above the language's share."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = stored(term_counts(rows, min_docs), "kept")
    terms = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = stored(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                    .select("lang", "source", zero("total"), zero("v"), zero("lang_total")), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))

    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(shares, groups, terms, tile_terms, source_block).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return above.select("*", place).filter(F.col("rank") <= top).unionByName(pairs.select("*", place))


KEY = ["of_lang", "of_tile", "of_i", "of_j"]


def _named(names: list[str], *cols: str) -> list[Column]:
    return [F.col(c).alias(n) for c, n in zip(cols, names)]


def _pairs(shares: DataFrame, groups: DataFrame, terms: DataFrame, tile_terms: int, source_block: int) -> DataFrame:
    """(lang, source, item, value): summed gaps of every two sources of a language."""
    sizes = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.max("v") / tile_terms)).cast("int").alias("tiles"),
                                       F.ceil(F.count(F.lit(1)) / source_block).cast("int").alias("sides"))
    tile = F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")
    b = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int").alias("b")
    # the two blocks of sources whose sources meet
    others = F.explode(F.transform(F.sequence(F.lit(0), F.col("sides") - 1), lambda k: F.struct(
        F.least("b", k).alias("i"), F.greatest("b", k).alias("j")))).alias("m")
    held = shares.select("lang", "source", "term", "p").join(sizes, "lang").select("*", b).select(
        "lang", tile.alias("tile"), "source", "term", "p", others).select(*_named(KEY, "lang", "tile", "m.i", "m.j"), "source", "term", "p")
    in_tile = terms.select("lang", "term").join(sizes, "lang").groupBy("lang", tile.alias("tile")).agg(F.count(F.lit(1)).alias("v_tile"))
    sides = (groups.join(sizes, "lang").select(
        "lang", "source", share(F.lit(0).cast("bigint"), F.col("total"), F.col("v")).alias("p0"), b, "sides",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).join(in_tile, ["lang", "tile"], "left")
        .select("lang", "tile", "source", "p0", "b", F.coalesce("v_tile", F.lit(0)).cast("bigint").alias("v"), others)
        .select("lang", "tile", "m.i", "m.j", "source", "p0", "b", "v"))
    tiles = held.groupBy(*KEY).cogroup(sides.groupBy("lang", "tile", "i", "j")).applyInArrow(_tile_sums, "lang string, source string, item string, value bigint")
    return tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
