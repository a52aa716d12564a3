"""Export sinks (A9, A10, A11): flat CSV, nested JSON, filtered report.

Outputs are Spark directories (one part file per task), written in parallel;
nothing is gathered on the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.report import REPORT_HEADER, REPORT_COLS

FORMATS = ("csv", "json")


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """Header row; null -> empty field; '' -> quoted empty string; quotes inside a
    field are doubled, as other CSV readers expect."""
    (df.write.mode(mode).option("header", header).option("nullValue", "").option("emptyValue", '""')
     .option("quote", '"').option("escape", '"').csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines keeping null keys (as the original's dump keeps them)."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def export_flat_csv(flat_rows: DataFrame, path: str) -> str:
    """Flat export rows (see `operators.report.flat_export`) as CSV."""
    return write_csv(flat_rows, path)


def export_nested_json(nested_rows: DataFrame, path: str) -> DataFrame:
    """A10: nested landing-shaped rows as JSON; returns a one-row count frame."""
    write_json(nested_rows.drop("file_id") if "file_id" in nested_rows.columns else nested_rows, path)
    return nested_rows.sparkSession.read.json(path).agg(F.count(F.lit(1)).cast("bigint").alias("exported"))


def export_report(results: DataFrame, out_dir: str, fmt: str = "csv", clock: _dt.datetime | None = None) -> str:
    """A search result (limit 1000 in the original) written as
    `code_export_<ts>.<fmt>` under `out_dir`; CSV gets the fixed header and
    Yes/No + joined tags, JSON keeps the raw rows. Other formats raise."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    ts = (clock or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    path = f"{out_dir.rstrip('/')}/code_export_{ts}.{fmt}"
    if fmt == "csv":
        from quarry.operators.report import report_rows
        rows = report_rows(results)
        rows = rows.select(*[F.col(c).alias(h) for c, h in zip(REPORT_COLS, REPORT_HEADER)])
        write_csv(rows, path)
    else:
        write_json(results, path)
    return path
