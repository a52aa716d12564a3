r"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are lower-cased in A-Z and cut into words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
A window is `width` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window of its own length. The windows' hashes are
broadcast; map tasks hash every word window of their documents, look it up, and
compare the words themselves before they report a hit. Nothing is shuffled.

Repeated items count once and long ones are cut into pieces whose windows are theirs, which are dealt by hash into as
many blocks as the text of all has `block_bytes`; a broadcast holds one block. Each is scanned against all documents, with the
hits so far carried along (and written to the shared folder after every CHAIN blocks).

A null text has no words. A null item_id is reported as an empty string. Rows
are judged each for itself, so repeated rows and null ids pass through; an empty
benchmark hits nothing. `remove` gives back the columns of its input whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.llm.store import carried, put_back, python_ready, stored
from quarry.llm.words import LOWER, NOT_ALNUM, find_words, hash_windows, hash_words, slices, text_buffer

WIDTH = 13
BLOCK_BYTES = 16 << 20
CHAIN = 3
PIECE_WORDS = 4096
FILTER_BITS = 22
RUNS = "array<struct<a:bigint,b:bigint>>"
SPANS = "array<struct<start:bigint,end:bigint>>"


class WindowIndex:
    """Hashes of a block's windows, with the words to verify a hit."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = [n for n, _ in items]
        buf, off = text_buffer(pa.array([t for _, t in items], pa.string()))
        starts, ends, rows = find_words(buf, off, NOT_ALNUM)
        self.buf, self.starts, self.ends = LOWER[buf].tobytes(), starts, ends
        words = hash_words(buf, starts, ends)
        at: dict[int, list[np.ndarray]] = {}
        item = np.repeat(np.arange(len(items)), np.diff(rows))
        for a, b in zip(rows[:-1], rows[1:]):
            if b > a:
                n = min(width, b - a)
                at.setdefault(int(n), []).append(np.arange(a, b - n + 1))
        self.lengths = {}
        for n, firsts in at.items():
            first = np.concatenate(firsts)
            h = hash_windows(words, n)[first]
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[h >> np.uint64(64 - FILTER_BITS)] = True
            self.lengths[n] = (h[order], first[order], item[first[order]], seen)

    def key(self, first: int, n: int) -> list[bytes]:
        return [self.buf[a:b] for a, b in zip(self.starts[first:first + n], self.ends[first:first + n])]

    def scan(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list], dict[int, set]]:
        """Word starts, ends and row offsets; windows hit (first word, length) and items by row."""
        starts, ends, rows = find_words(buf, off, NOT_ALNUM)
        words = hash_words(buf, starts, ends)
        hits: dict[int, list] = {}
        found: dict[int, set] = {}
        for n, (hashes, first, item, seen) in self.lengths.items():
            h = hash_windows(words, n)
            maybe = np.flatnonzero(seen[h >> np.uint64(64 - FILTER_BITS)])
            row = np.searchsorted(rows, maybe, side="right") - 1
            maybe, row = maybe[maybe + n <= rows[row + 1]], row[maybe + n <= rows[row + 1]]
            lo, hi = np.searchsorted(hashes, h[maybe]), np.searchsorted(hashes, h[maybe], side="right")
            known: dict[int, list[bytes]] = {}
            for i, r, a, b in zip(maybe[lo < hi].tolist(), row[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                own = [LOWER[buf[s:e]].tobytes() for s, e in zip(starts[i:i + n], ends[i:i + n])]
                same = [j for j in range(a, b) if (known.get(j) or known.setdefault(j, self.key(int(first[j]), n))) == own]
                if same:
                    hits.setdefault(r, []).append((i - int(rows[r]), n))
                    found.setdefault(r, set()).update(self.names[item[j]] for j in same)
        return starts, ends, rows, hits, found


def merge_runs(windows: list[tuple[int, int]], runs: list[dict]) -> list[dict]:
    """Disjoint word ranges [a, b) that cover the windows and the earlier runs."""
    out: list[dict] = []
    for a, b in sorted([(x, x + n) for x, n in windows] + [(r["a"], r["b"]) for r in runs]):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


def _scan_block(index, text: str, first: bool):
    """Adds (or, for later blocks, extends) the columns __words, __runs, __items, __spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        for batch in batches:
            for part in slices(batch, text):
                buf, off = text_buffer(part.column(text))
                starts, ends, rows, hits, found = block.scan(buf, off)
                n = part.num_rows
                if first:
                    runs, items, spans = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                    columns, names = list(part.columns), list(part.schema.names)
                else:
                    runs, items, spans = (part.column(c).to_pylist() for c in ("__runs", "__items", "__spans"))
                    columns = [c for c, f in zip(part.columns, part.schema.names) if f not in ("__words", "__runs", "__items", "__spans")]
                    names = [f for f in part.schema.names if f not in ("__words", "__runs", "__items", "__spans")]
                for r, windows in hits.items():
                    runs[r] = merge_runs(windows, runs[r])
                    items[r] = sorted(found[r] | set(items[r]))
                    body, done, chars, spans[r] = buf[off[r]:off[r + 1]].tobytes(), 0, 0, []
                    for x in runs[r]:
                        a, b = int(starts[rows[r] + x["a"]] - off[r]), int(ends[rows[r] + x["b"] - 1] - off[r])
                        chars += len(body[done:a].decode())
                        start, chars, done = chars, chars + len(body[a:b].decode()), b
                        spans[r].append({"start": start, "end": chars})
                long = pa.int64()
                columns += [pa.array(np.diff(rows), long),
                            pa.array(runs, pa.list_(pa.struct([("a", long), ("b", long)]))),
                            pa.array(items, pa.list_(pa.string())),
                            pa.array(spans, pa.list_(pa.struct([("start", long), ("end", long)])))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "__words", "__runs", "__items", "__spans"])
    return run


def _pieces(items: DataFrame, width: int) -> DataFrame:
    """Distinct (id, body): items longer than PIECE_WORDS words in pieces that share width - 1 words, so that all
    windows are there and no piece is larger than its words."""
    words = F.regexp_extract_all("body", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)), F.lit(PIECE_WORDS)),
                      lambda i: F.array_join(F.slice(words, i + 1, PIECE_WORDS + width - 1), " "))
    long = F.octet_length("body") > PIECE_WORDS * 2
    return items.select("id", F.explode(F.when(long, cut).otherwise(F.array("body"))).alias("body")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with __words (count), __runs (word ranges hit), __items (ids, sorted) and __spans (code point ranges hit)."""
    spark = docs.sparkSession
    python_ready(spark)
    items = _pieces(benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("id"),
                                     F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("body")), width)
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema = f"{plain}, __words bigint, __runs {RUNS}, __items array<string>, __spans {SPANS}"
    out = docs
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "body"), F.lit(blocks)) == k) if blocks > 1 else items
        held = spark.sparkContext.broadcast(WindowIndex([(r["id"], r["body"]) for r in part.collect()], width))
        out = out.mapInArrow(_scan_block(held, text, k == 0), schema)
        if k % CHAIN == CHAIN - 1 and k < blocks - 1:
            out = stored(out, "hits")
    return out


def verdict(scanned: DataFrame) -> DataFrame:
    """Adds __hit (words hit) and __bad: contaminated if at least one word in twenty is hit."""
    hit = F.aggregate("__runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    return scanned.withColumn("__hit", hit).withColumn("__bad", (F.col("__hit") > 0) & (20 * F.col("__hit") >= F.col("__words")))


def flag(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated) of every document."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast(StringType()).alias("text"))
    return verdict(scan(rows, benchmark, "text", **how)).select(
        "doc_id", F.col("__words").alias("n_words"), F.col("__hit").alias("n_hit"), F.col("__items").alias("items"),
        F.col("__spans").alias("spans"), F.col("__bad").alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", spans_only: bool = False, **how) -> DataFrame:
    """`docs` without contaminated documents or, with `spans_only`, without the spans hit in any document."""
    rows = docs.select(carried(docs, text).alias("row"), F.col(f"`{text}`").alias("text"))
    seen = verdict(scan(rows, benchmark, "text", **how))
    if not spans_only:
        return seen.filter(~F.col("__bad")).select(*put_back(docs, **{text: F.col("text")}))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("__spans.end"))
    starts = F.concat(F.col("__spans.start"), F.array(F.length("text").cast("long")))
    kept = F.concat_ws("", F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))))
    return seen.select(*put_back(docs, **{text: F.when(F.size("__spans") > 0, kept).otherwise(F.col("text"))}))
