r"""Line dedup over levelled sorted runs.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z
in lower case; keys of `min_chars` code points or more count. The store keeps
one entry (key hash, holder) per key in runs: tables bucketed and sorted by the
key hash. A batch first reduces its lines to one entry per key, looks these up
in every run by merge joins that shuffle only the batch's entries, and adds the
new ones as a run of level 0. When a level has `fanout` runs they are merged
into one run of the next level, so a lookup touches a logarithmic number of
runs. Keys are 128-bit hashes.

The holder of a key is the smallest doc_id of the first batch that had it; in
batches that come by rising doc_id it is the smallest of all. All lines with the
key go, but for those in its holder.

A null text is one empty line. Rows with a null doc_id are not judged: they
keep their lines and hold no key. Rows that repeat a doc_id belong to one
document. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.expr import WHITE, let, lower_ascii
from quarry.llm.store import carried, drop, fresh, keyed_text, put_back, stored

KEY = ["k1", "k2"]
MIN_CHARS = 10
FANOUT = 3
BATCHES = 4


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def line_rows(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, body, at, k1, k2): every line that counts; `body` tells apart texts of one doc_id."""
    lines = texts.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return (lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
            .select("doc_id", "body", "at", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(17), "key").alias("k2")))


class LineRuns:
    """The store of line keys: runs by level, newest last."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name, _ in level]

    def _write(self, entries: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", fresh(self.spark, "line-run")
        (entries.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", path).saveAsTable(name))
        return name, path

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, path)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch (doc_id, k1, k2, ...); returns its keys' holders (k1, k2, holder, known).

        `known` tells whether an earlier batch had the key.
        """
        own = lines.groupBy(*KEY).agg(F.min("doc_id").alias("holder"))
        old = F.lit(None)
        for i, run in enumerate(self.runs()):
            own = own.join(run.withColumnRenamed("holder", f"run{i}"), KEY, "left")
            old = F.coalesce(old, F.col(f"run{i}"))
        holders = stored(own.select(*KEY, F.coalesce(old, F.col("holder")).alias("holder"), old.isNotNull().alias("known")), "holders")
        self._add_run(holders.filter("NOT known").select(*KEY, "holder"))
        return holders

    def _add_run(self, entries: DataFrame) -> None:
        run, level = self._write(entries), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0][0])
            for name, _ in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            run = self._write(merged)
            self._forget(full)
            level += 1

    def close(self) -> None:
        """Forget all runs."""
        for level in self.levels:
            self._forget(level)
        self.levels = []


def dropped_lines(texts: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, body, gone): sorted positions of the lines to drop, for texts that lose any.

    The documents come in `batches` ranges of doc_id, cut at its quantiles.
    """
    spark = texts.sparkSession
    lines = stored(line_rows(texts, min_chars), "lines")
    points = [i / batches for i in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc_id", points, 1000).alias("c")).first()["c"] if points else []
    cuts = sorted(set(cuts or []))
    store, late = LineRuns(spark, fanout), None
    try:
        for i in range(len(cuts) + 1):
            batch = lines
            if i > 0:
                batch = batch.filter(F.col("doc_id") > F.lit(cuts[i - 1]))
            if i < len(cuts):
                batch = batch.filter(F.col("doc_id") <= F.lit(cuts[i]))
            holders = store.add(batch)
            # only keys that some document loses lines for
            gone = batch.join(holders, KEY).filter("holder < doc_id").select("doc_id", "body", "at")
            late = gone if late is None else late.unionByName(gone)
        return stored(late.groupBy("doc_id", "body").agg(F.sort_array(F.collect_set("at")).alias("gone")), "dropped")
    finally:
        store.close()


def without(lines: Column, gone: Column) -> Column:
    """`lines` less the sorted positions `gone`: the stretches between them, joined."""
    def stretch(j: Column) -> Column:
        first = F.coalesce(F.get(gone, j - 1) + 1, F.lit(0))
        return F.slice(lines, first + 1, F.coalesce(F.get(gone, j), F.size(lines)) - first)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), stretch))


def _kept_lines(docs: DataFrame, key: str, text: str, batches: int, min_chars: int) -> DataFrame:
    """(row, text, n_lines, n_dropped): `row` carries the other columns of `docs`."""
    gone = dropped_lines(keyed_text(docs, key, text), batches, min_chars)
    gone = gone.select(F.col("doc_id").alias("of"), F.col("body").alias("of_body"), "gone")
    rows = docs.select(carried(docs, text).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = rows.join(gone, (F.col("id") == F.col("of")) & (F.xxhash64(body) == F.col("of_body")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(
        F.split(body, "\n"), lambda lines: F.array_join(without(lines, F.col("gone")), "\n")))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long")
    return joined.select("row", kept.alias("text"), F.size(F.split(body, "\n")).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with two more columns: `n_lines`, `n_dropped`; `text` holds the lines that stay.

    Columns of these two names in `docs` give way; `without_repeats` keeps them."""
    counts = ["n_lines", "n_dropped"]
    cols = put_back(docs, **{text: F.col("text")})
    return _kept_lines(docs, key, text, batches, min_chars).select(*[c for c, n in zip(cols, docs.columns) if n not in counts], *counts)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES,
                    min_chars: int = MIN_CHARS) -> DataFrame:
    """The columns of `docs`, whatever their names; `text` holds the lines that stay, and a column of lengths `n_chars` follows it."""
    instead = {text: F.col("text")}
    if "n_chars" in docs.columns and "n_chars" not in (key, text):
        instead["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _kept_lines(docs, key, text, batches, min_chars).select(*_back(docs, text, instead))


def _back(docs: DataFrame, text: str, instead: dict) -> list:
    back = put_back(docs, **{text: instead[text]})
    return [instead[c].alias(c) if c in instead else b for c, b in zip(docs.columns, back)]
