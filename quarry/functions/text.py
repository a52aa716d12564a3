"""Small text/path/url/type expressions: content decode (A5), lenient read
(A7), landing path (A6), URL split (B14), preview (B13), basename/dirname
(C9), Unknown/zero defaults (C8), bool<->int (C6), timestamps (C10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.schema import DEFAULT_REPO_HOST


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_content(b64) -> Column:
    """base64 -> strict UTF-8 text; bad base64 or bad UTF-8 give null.
    Line breaks inside the base64 body are accepted."""
    raw = F.try_to_binary(F.regexp_replace(_c(b64), r"[\r\n]", ""), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))


def lenient_text(binary_col) -> Column:
    """Bytes -> text dropping invalid sequences and nothing else. Valid input
    stays in the JVM; only invalid bytes go through Arrow to be decoded."""
    @F.pandas_udf(StringType())          # local, so that it is shipped with its code
    def decode_ignoring(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    b = _c(binary_col)
    as_str = b.cast("string")
    valid = F.is_valid_utf8(as_str)
    return F.when(valid, as_str).otherwise(decode_ignoring(F.when(~valid, b)))


def landing_path(out_dir: str, full_name, path) -> Column:
    """<out>/<owner>_<repo>/<path>; null when the path is null."""
    return F.when(_c(path).isNotNull(), F.concat_ws(
        "/", F.lit(out_dir.rstrip("/")), F.replace(_c(full_name), F.lit("/"), F.lit("_")), _c(path)))


def parse_repo_url(url, host: str = DEFAULT_REPO_HOST) -> Column:
    """struct(host, owner, repo, is_valid): trim '/', split on '/', need at
    least 5 parts with the third equal to `host`."""
    parts = F.split(F.regexp_replace(_c(url), r"^/+|/+\z", ""), "/", -1)
    n = F.size(parts)
    h = F.get(parts, 2)
    valid = F.coalesce((n >= 5) & (h == F.lit(host)), F.lit(False))
    return F.struct(h.alias("host"),
                    F.when(valid, F.get(parts, 3)).alias("owner"),
                    F.when(valid, F.get(parts, 4)).alias("repo"),
                    valid.alias("is_valid"))


def preview(text, n: int = 1000) -> Column:
    t = _c(text)
    return F.concat(F.substring(t, 1, n), F.when(F.length(t) > n, F.lit("...")).otherwise(F.lit("")))


def basename(path) -> Column:
    return F.element_at(F.split(_c(path), "/", -1), -1)


def dirname(path) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*\z", "")


def path_depth(path) -> Column:
    p = _c(path)
    return (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("bigint")


def or_unknown(col) -> Column:
    c = _c(col)
    return F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(c)


def or_zero(col) -> Column:
    return F.coalesce(_c(col), F.lit(0))


def bool_to_int(col) -> Column:
    return F.coalesce(_c(col), F.lit(False)).cast("int")


def int_to_bool(col) -> Column:
    return F.coalesce(_c(col), F.lit(0)).cast("boolean")


def parse_iso(col) -> Column:
    """ISO-8601 text (with 'T' or space, optional fraction) -> timestamp_ntz."""
    return F.to_timestamp_ntz(F.regexp_replace(_c(col), "T", " "))
