r"""Packing into optimal length buckets.

Texts are counted in words ``[^\x20\x09-\x0D]+`` (the length measure; any other
integer column can be given) and cut into pieces of at most `max_len`, so a very
long text becomes several sequences and nothing is dropped. The histogram of all
lengths, at most ``max_len + 1`` rows whatever the data, goes to the driver,
where dynamic programming picks the bucket lengths with the least padding over
all sequences. Each bucket's sequences then form batches of
``budget // bucket length`` sequences.

Sequences are numbered within a bucket without gathering it: they are dealt by
hash into shards of about SHARD rows, numbered there, and the shards' counts
give the offsets, so all batches of a bucket but its last are full.

A null or empty text is a sequence of length 0 in the shortest bucket. Null ids
and repeated rows are sequences like any other; an empty table packs into
nothing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.expr import words_of
from quarry.llm.store import keyed_text, stored

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 32_768
SHARD = 50_000


def bucket_lengths(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most `buckets` lengths, the longest included, that minimise the padding
    of the histogram when every sequence is padded to the next of them."""
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    order = np.argsort(x)
    x, c = x[order], c[order]
    n = len(x)
    many, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # best[j]: least padding of the j shortest lengths in the buckets so far
    best, choice = np.full(n + 1, np.inf), []
    best[0] = 0
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0
        for j in range(1, n + 1):
            pad = best[:j] + (x[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j]))
            cut[j] = int(np.argmin(pad))
            now[j] = pad[cut[j]]
        best = now
        choice.append(cut)
    out, j = [], n
    for cut in reversed(choice):
        if j == 0:
            break
        out.append(int(x[j - 1]))
        j = int(cut[j])
    return sorted(out)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
              length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens): the pieces of every document."""
    if length is None:
        rows = keyed_text(docs, key, text).select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n"))
    else:
        rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0)).cast("int")
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("long") * max_len
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", max_len: int = MAX_LEN, buckets: int = BUCKETS,
         budget: int = BUDGET, length: Column | None = None, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, bucket_len, batch, slot) of every sequence.

    `batch` counts from 0 within its bucket, `slot` within its batch.
    """
    if budget < max_len:
        raise ValueError("a batch must hold a sequence of max_len")
    seqs = stored(sequences(docs, key, text, max_len, length), "sequences")
    # one row per length, max_len + 1 at most
    hist = seqs.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()
    if not hist:
        bounds, shards = [max_len], [1]
    else:
        bounds = bucket_lengths([r["n_tokens"] for r in hist], [r["c"] for r in hist], buckets)
        bounds = sorted({max(1, b) for b in bounds})
        home = np.searchsorted(bounds, [r["n_tokens"] for r in hist])
        rows = np.bincount(home, weights=[r["c"] for r in hist], minlength=len(bounds))
        shards = [int(max(1, -(-n // shard_rows))) for n in rows]
    lens, parts = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*map(F.lit, shards))
    dealt = (seqs.withColumn("bucket", F.size(F.filter(lens, lambda b: b < F.col("n_tokens"))))
             .withColumn("h", F.xxhash64("doc_id", "piece"))
             .withColumn("shard", F.pmod("h", F.get(parts, F.col("bucket"))).cast("int")))
    counts = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "piece")) - 1
    placed = dealt.withColumn("at", at).join(offsets, ["bucket", "shard"]).withColumn("at", F.col("at") + F.col("offset"))
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (placed.withColumn("bucket_len", F.get(lens, F.col("bucket")))
            .select("doc_id", "piece", "start", "n_tokens", "bucket", "bucket_len",
                    F.floor(F.col("at") / size).alias("batch"), F.pmod(F.col("at"), size).cast("long").alias("slot")))
