"""Content-addressed text store and score cache of a catalogue.

Below the catalogue's root:

  texts/       (digest, content)              every distinct text once; digest = SHA-256 of its UTF-8 bytes
  text_paths/  (local_path, digest, version)  log of which text stands under a path; the latest version counts
  scores/      (digest, rules, version, signals ...)   signals of every distinct text, once per set of lint rules

All three are only appended to. Keys are joined first: a batch's digests are anti-joined against the
stored digests (their column alone is read), and only texts that are new are moved and written. Files of `texts` carry
Parquet Bloom filters on the digest, so a lookup skips row groups that cannot hold it. Doing a batch again
adds nothing: digests known are left out, and a path's repeated version folds to the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.suitability import SIGNALS, score_contents
from quarry.schema import LintRules, Thresholds
from quarry.sources.landing import path_exists
from quarry.sources.tables import observed, observed_count, stored


def text_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def _append_keyed(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("append").option("parquet.bloom.filter.enabled#" + key, "true").parquet(path)


def store_texts(rows: DataFrame, root: str, version: int) -> int:
    """Store the texts of `rows` (local_path, content) under their paths; null texts are left out. Of several
    texts for one path in a batch the one with the greatest digest stays. Returns the number of texts that were new."""
    spark = rows.sparkSession
    keyed = stored(rows.select("local_path", "content").filter("local_path IS NOT NULL AND content IS NOT NULL")
                   .withColumns({"digest": text_digest(F.col("content")), "row": F.monotonically_increasing_id()}), "texts")
    firsts = keyed.groupBy("digest").agg(F.min("row").alias("row"))
    if path_exists(spark, f"{root}/texts"):
        firsts = firsts.join(spark.read.parquet(f"{root}/texts").select("digest"), "digest", "left_anti")
    new = keyed.join(firsts, "row", "left_semi").select("digest", "content")
    new, seen = observed(new)
    _append_keyed(new, f"{root}/texts", "digest")
    keyed.groupBy("local_path").agg(F.max("digest").alias("digest")).select("local_path", "digest", F.lit(version).cast("bigint").alias("version")) \
        .write.mode("append").parquet(f"{root}/text_paths")
    return observed_count(seen)


def current_paths(spark: SparkSession, root: str) -> DataFrame | None:
    """(local_path, digest): the latest text of every path; None without a store."""
    if not path_exists(spark, f"{root}/text_paths"):
        return None
    log = spark.read.parquet(f"{root}/text_paths")
    return log.groupBy("local_path").agg(F.max(F.struct("version", "digest")).alias("_last")).select("local_path", F.col("_last.digest").alias("digest"))


def stored_texts(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame | None:
    """(local_path, digest, content) of all stored paths, or of those in `paths` (local_path)."""
    held = current_paths(spark, root)
    if held is None:
        return None
    if paths is not None:
        held = held.join(paths.select("local_path").distinct(), "local_path", "left_semi")
    return held.join(spark.read.parquet(f"{root}/texts"), "digest").select("local_path", "digest", "content")


def rules_key(rules: LintRules) -> str:
    """What signals depend on besides the text."""
    return ";".join(f"{k}={v}" for k, v in sorted(vars(rules).items()))


def cached_scores(texts: DataFrame, root: str, th: Thresholds = Thresholds(), version: int = 0) -> tuple[DataFrame, int]:
    """Signals of `texts` (local_path, content) by way of the score table below `root`.

    Only texts whose digest has no score for these lint rules go through the scoring pass, each once;
    their scores are appended with `version`, the batch that needed them first. Returns (local_path, *SIGNALS) and the number of texts scored."""
    spark, rules = texts.sparkSession, rules_key(th.lint)
    path = f"{root}/scores"
    keyed = stored(texts.select("local_path", "content").withColumns(
        {"digest": F.coalesce(text_digest(F.col("content")), F.lit("")), "row": F.monotonically_increasing_id()}), "to-score")

    def known() -> DataFrame | None:
        return spark.read.parquet(path).filter(F.col("rules") == rules) if path_exists(spark, path) else None
    firsts = keyed.groupBy("digest").agg(F.min("row").alias("row"))
    if known() is not None:
        firsts = firsts.join(known().select("digest"), "digest", "left_anti")
    new, seen = observed(keyed.join(firsts, "row", "left_semi").select("digest", "content"))
    scored = score_contents(new, th, "digest")
    _append_keyed(scored.select("digest", F.lit(rules).alias("rules"), F.lit(version).cast("bigint").alias("version"), *SIGNALS), path, "digest")
    signals = known().groupBy("digest").agg(F.min(F.struct(*SIGNALS)).alias("s"))
    by_path = keyed.groupBy("local_path").agg(F.max("digest").alias("digest")).join(signals, "digest").select("local_path", "s.*")
    return by_path, observed_count(seen)
