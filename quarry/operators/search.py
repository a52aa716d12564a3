"""Catalogue search and lookup.

Filters are composed only when requested, so Catalyst pushes them to the
Parquet scan; the ordered limit runs as TakeOrderedAndProject (per-partition
top-k, then a k-row merge); tags are attached after the limit to the k rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import preview
from quarry.operators.catalog import files_with_repos
from quarry.operators.tags import any_tag_files, attach_tags
from quarry.schema import SEARCH_LIMIT

# Result rows whose ids may be broadcast (8 bytes each).
MAX_BROADCAST_ROWS = 100_000
RESULT_COLS = ["id", "name", "path", "local_path", "quality_score", "code_lines", "is_suitable", "repo_name"]


def like_pattern(text: str) -> str:
    """'%text%' for Spark LIKE: '%' and '_' in the text stay wildcards (as in
    the original); backslash is Spark's escape character, so it is doubled."""
    return "%" + text.replace("\\", "\\\\") + "%"


def text_predicate(query: str | None, cols=("name", "path", "repo_short_name", "repo_name")) -> Column | None:
    """OR of case-insensitive LIKE over file name, path, repo name, repo full name."""
    if not query:
        return None
    pat = like_pattern(query)
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pat) for c in cols])


def normalize_limit(limit) -> int | None:
    """None or negative -> unlimited; blank text -> the default limit."""
    if limit is None:
        return None
    if isinstance(limit, str) and not limit.strip():
        return SEARCH_LIMIT
    limit = int(limit)
    return None if limit < 0 else limit


def limit_column(text: Column) -> Column:
    """`normalize_limit` of a column of texts; one that is no number is an error."""
    limit = text.cast("bigint")
    return F.when(text.rlike(r"^\s*$"), F.lit(SEARCH_LIMIT).cast("bigint")).when(limit >= 0, limit)


def normalize_min_quality(value):
    """Blank -> None (no predicate); else float."""
    if value is None or (isinstance(value, str) and value.strip() == ""):
        return None
    return float(value)


def search(files: DataFrame, repos: DataFrame, links: DataFrame | None = None, query: str | None = None,
           tags: list[str] | None = None, min_quality=None, suitable_only: bool = False,
           limit=SEARCH_LIMIT, with_tags: bool = True) -> DataFrame:
    """G1: filters -> order by score desc (nulls last), id -> limit -> tags.

    Only a text query reads repository columns before the limit. Without one
    the limit is taken from the files alone (kept to those whose repository
    exists), and without a limit nothing is sorted: a frame has no order then."""
    known = files.join(repos.select(F.col("full_name").alias("repo_full_name")), "repo_full_name", "left_semi")
    base = known.select(*[c for c in RESULT_COLS if c != "repo_name"], F.col("repo_full_name").alias("repo_name"))
    pred = text_predicate(query)
    if pred is not None:
        base = files_with_repos(files, repos).select(
            *[c for c in RESULT_COLS if c != "repo_name"],
            F.col("repo_full_name").alias("repo_name"), F.col("repo_name").alias("repo_short_name")).filter(pred)
    if tags:
        base = any_tag_files(base, links, tags)
    mq = normalize_min_quality(min_quality)
    if mq is not None:
        base = base.filter(F.col("quality_score") >= F.lit(mq))
    if suitable_only:
        base = base.filter(F.col("is_suitable"))
    base = base.select(*RESULT_COLS)
    order = [F.desc_nulls_last("quality_score"), F.asc("id")]
    lim = normalize_limit(limit)
    if lim is not None:
        base = base.orderBy(*order).limit(lim)
    if with_tags and links is not None:
        base = attach_tags(base, links, lim if lim is not None and lim <= MAX_BROADCAST_ROWS else None)
        if lim is not None:
            # the join does not keep row order: sort the (at most `limit`) rows again
            base = base.orderBy(*order)
    return base


def lookup(files: DataFrame, ids: DataFrame, contents: DataFrame | None = None,
           preview_chars: int | None = 1000) -> DataFrame:
    """B12 (+B13): rows for the requested ids — any id in the catalogue, not
    only the top-scored ones — with the stored text or its preview."""
    hit = files.join(ids.select(F.col("id").cast("bigint").alias("id")).distinct(), "id", "left_semi")
    if contents is None:
        return hit
    out = hit.join(contents, "id", "left")
    if preview_chars is not None:
        out = out.withColumn("preview", preview(F.col("content"), preview_chars)).drop("content")
    return out
