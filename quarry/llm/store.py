"""Written intermediate tables: lineage is cut by Parquet in the shared folder.

The folder is the session's sub-folder of ``spark.checkpoint.dir``; a lost
executor never takes such a table with it, and a re-run of a task reads the
same rows again.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import drop_path, scratch_path

ROWS, BYTES = 1000, 8 << 20
_SHIPPED: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """What operators with Python tasks need of a session.

    Rows carry whole texts, so Arrow batches are kept to ROWS rows and BYTES bytes
    (a session with smaller ones keeps its own). Executors get the package's
    modules with the tasks, wherever the driver was started.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = re.fullmatch(r"(\d+)b?", (spark.conf.get(key, None) or "").lower())     # a number, or with a larger unit
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="quarry-modules-"), "quarry_modules.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, package)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a fresh folder and return the table read back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def drop(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str = "doc_id", text: str = "text", null: str | None = "") -> DataFrame:
    """The two columns an operator needs, whatever else the table holds."""
    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), (body if null is None else F.coalesce(body, F.lit(null))).alias("text"))


def carried(docs: DataFrame, *but: str):
    """Struct of the columns of `docs` other than `but`, under names of their own, so that no column an
    operator adds can clash with them."""
    rest = [c for c in docs.columns if c not in but]
    return F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])


def put_back(docs: DataFrame, row: str = "row", **instead) -> list:
    """The columns of `docs` in their order, out of what `carried` made; `instead` has those that were left out of it."""
    rest = [c for c in docs.columns if c not in instead]
    return [instead[c].alias(c) if c in instead else F.col(row).getField(f"c{rest.index(c)}").alias(c) for c in docs.columns]
