"""Projections for exports and display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.signals import py_fixed1
from quarry.functions.text import bool_to_int, parse_iso
from quarry.operators.catalog import files_with_repos
from quarry.schema import REPORT_HEADER  # noqa: F401  (re-exported for the export sink)

# Column order of the flat CSV export.
FLAT_EXPORT_COLS = ["repo_name", "repo_full_name", "repo_url", "repo_stars", "repo_license", "file_name",
                    "file_path", "file_url", "local_path", "quality_score", "code_lines", "is_suitable",
                    "unsuitable_reason", "complexity_avg", "complexity_max", "function_count", "downloaded_at"]
REPORT_COLS = ["id", "name", "repo_name", "quality_score", "code_lines", "suitable", "tags", "local_path"]
FLAT_TABLE_COLS = ["repo_name", "file_name", "file_path", "local_path", "file_url", "quality_score", "downloaded_at"]


def _catalog_rows(files: DataFrame, repos: DataFrame) -> DataFrame:
    j = files_with_repos(files, repos)
    return j.select(
        "repo_name", F.col("repo_full_name"), "repo_url", "repo_stars", "repo_license",
        F.col("name").alias("file_name"), F.col("path").alias("file_path"), F.col("url").alias("file_url"),
        "local_path", "quality_score", "code_lines", "is_suitable", "unsuitable_reason",
        "complexity_avg", "complexity_max", "function_count", "downloaded_at", F.col("id").alias("file_id"))


def flat_export(files: DataFrame, repos: DataFrame) -> DataFrame:
    """The 17 export columns in order; the verdict as 0/1. Write with
    `sinks.write_csv` (header, null -> empty field)."""
    rows = _catalog_rows(files, repos)
    return rows.select(*[bool_to_int("is_suitable").alias("is_suitable") if c == "is_suitable" else F.col(c)
                         for c in FLAT_EXPORT_COLS])


def nested_export(files: DataFrame, repos: DataFrame) -> DataFrame:
    """A10: landing-shaped rows with the complexity columns nested again and
    the verdict as boolean; the landing becomes the deduplicated catalogue."""
    rows = _catalog_rows(files, repos)
    cx = F.struct(F.col("complexity_avg").alias("avg_complexity"),
                  F.col("complexity_max").alias("max_complexity"),
                  F.col("function_count").alias("function_count"))
    return rows.select(
        "repo_name", "repo_full_name", "repo_url", "repo_stars", "repo_license", "file_name", "file_path",
        "file_url", "local_path", "quality_score", "code_lines",
        F.coalesce(F.col("is_suitable"), F.lit(False)).alias("is_suitable"), "unsuitable_reason",
        F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss").alias("downloaded_at"),
        cx.alias("complexity"), "file_id")


def display_rows(results: DataFrame) -> DataFrame:
    """Score '%.1f' or 'N/A' for null / 0, flag Yes/No, tags joined ', '."""
    s = F.col("quality_score")
    score_txt = F.when(s.isNull() | (s == 0), F.lit("N/A")).otherwise(py_fixed1(s))
    return results.select(
        "id", "name", "repo_name", score_txt.alias("score_text"), "code_lines",
        F.when(F.coalesce(F.col("is_suitable"), F.lit(False)), "Yes").otherwise("No").alias("suitable"),
        F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ", ").alias("tags"),
        "local_path")


def report_rows(results: DataFrame) -> DataFrame:
    """A11 CSV rows: raw score, Yes/No, tags joined ', '."""
    return results.select(
        "id", "name", "repo_name", "quality_score", F.coalesce(F.col("code_lines"), F.lit(0)).alias("code_lines"),
        F.when(F.coalesce(F.col("is_suitable"), F.lit(False)), "Yes").otherwise("No").alias("suitable"),
        F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ", ").alias("tags"),
        "local_path")


def flat_table(landing: DataFrame, id_col: str | None = None) -> DataFrame:
    """Landing -> flat 7-column table, text timestamps parsed; every
    import appends (no dedup). `id_col` names the landing's arrival sequence."""
    ids = [F.col(id_col).cast("bigint").alias("id")] if id_col else []
    return landing.select(*ids, "repo_name", "file_name", "file_path", "local_path", "file_url",
                          F.col("quality_score").cast("double").alias("quality_score"),
                          parse_iso(F.col("downloaded_at")).alias("downloaded_at"))


def flat_dump(flat: DataFrame) -> DataFrame:
    """The three listed columns of every flat row."""
    return flat.select("repo_name", "file_name", "downloaded_at")


def required_field_gaps(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column, the number of rows where it is null or empty — one aggregate."""
    aggs = []
    for c in cols:
        v = F.col(c)
        empty = v.isNull() | (v.cast("string") == "")
        aggs.append(F.count_if(empty).cast("bigint").alias(f"missing_{c}"))
    aggs.append(F.count(F.lit(1)).cast("bigint").alias("rows"))
    return df.agg(*aggs)
