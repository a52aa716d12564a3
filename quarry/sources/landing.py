"""Landing metadata source and sink.

The landing is open JSON: every key optional, signals added later. It is
read with one explicit schema (never inferred). A JSON *array* file needs
`multiLine` and is not splittable; which files hold one is seen while the landing is parsed
as lines. Large landings should be JSON Lines or Parquet, which split across executors.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schema import LANDING_FIELDS, LANDING_SCHEMA

SEQ_SCHEMA = T.StructType(LANDING_SCHEMA.fields + [T.StructField("seq", T.LongType())])


CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType(SEQ_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or a pattern) names anything."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def scan_landing(spark: SparkSession, path: str | list[str], fmt: str = "json", array: bool | None = None) -> DataFrame:
    """Every record of a landing (a path, a pattern or a list of files), malformed ones with `_corrupt_record`, and its place.

    `arrival` orders rows that carry no `seq`: the file's time and name, the
    place of the split in the file, and the row's place in the split. A missing path gives an empty
    frame; any other failure to read is raised.

    `array` None: each file may hold JSON Lines or an array. The landing is parsed once, as lines, and kept as a
    written table; a file whose first record begins an array that its line does not end is read again as a
    whole. An array on one line is read as lines are."""
    paths = [path] if isinstance(path, str) else path
    paths = [p for p in paths if path_exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], T.StructType(READ_SCHEMA.fields + [ARRIVAL]))
    cols = [*[f.name for f in READ_SCHEMA.fields], arrival().alias("arrival")]
    if fmt == "parquet":
        return spark.read.schema(SEQ_SCHEMA).parquet(*paths).withColumn(CORRUPT, F.lit(None).cast("string")).select(*cols)

    def read(many: bool, files: list[str]) -> DataFrame:
        return (spark.read.schema(READ_SCHEMA).option("multiLine", many).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).json(files).select(*cols))
    if array is not None:
        return read(array, paths)
    from quarry.sources.tables import stored
    lines = stored(read(False, paths), "landing-lines")
    names = array_files(lines)
    if not names:
        return lines
    return lines.filter(~F.col("arrival.file_path").isin(names)).unionByName(read(True, [unquote(n) for n in names]))


def array_files(lines: DataFrame) -> list[str]:
    """Files of a landing parsed as lines whose first record begins a JSON array and does not end it.
    Only the names of such files come to the driver, which lists a landing's files anyway."""
    opens = F.col(CORRUPT).isNotNull() & F.regexp_replace(F.coalesce(CORRUPT, F.lit("")), r"^[\s\x{FEFF}]+", "").startswith("[")
    first = lines.groupBy(F.col("arrival.file_path").alias("file")).agg(F.min_by(opens, "arrival").alias("opens"))
    return sorted(r["file"] for r in first.filter("opens").select("file").collect())


ARRIVAL = T.StructField("arrival", T.StructType([
    T.StructField("file_time", T.TimestampType()), T.StructField("file_path", T.StringType()),
    T.StructField("split", T.LongType()), T.StructField("row", T.LongType())]))


def arrival() -> Column:
    """Place of a scanned row (see `scan_landing`)."""
    m = F.col("_metadata")
    return F.struct(m["file_modification_time"].alias("file_time"), m["file_path"].alias("file_path"),
                    m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("row"))


def read_landing(spark: SparkSession, path: str | list[str], fmt: str = "json", array: bool | None = None) -> DataFrame:
    """A1: landing rows with the fixed schema and their `arrival`; malformed
    records are left out (`landing_rejects` counts them)."""
    return whole_records(scan_landing(spark, path, fmt, array))


def whole_records(scanned: DataFrame) -> DataFrame:
    """The records of a scan that could be read."""
    # Spark refuses to read the column of malformed records alone, as a count would; the second
    # term names another one and is never true
    whole = F.col(CORRUPT).isNull() | (F.octet_length(CORRUPT) + F.octet_length("repo_name") < 0)
    return scanned.filter(whole).drop(CORRUPT)


def reject_reason() -> Column:
    """Why an import leaves a scanned record out; null where it does not."""
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record"))
    reason = reason.when(~F.coalesce(F.col("repo_full_name") != "", F.lit(False)), F.lit("no repository"))
    for c in ("file_name", "file_path", "file_url", "local_path"):
        reason = reason.when(F.col(c).isNull(), F.lit(f"no {c}"))
    return reason


def rejected(scanned: DataFrame) -> DataFrame:
    """J1's dead letters: (file, split, row, record, reason) of each record of a scan that an import leaves out.
    `record` is a malformed record's own text, else the row as JSON."""
    fields = [c for c in scanned.columns if c in SEQ_SCHEMA.fieldNames()]
    body = F.when(F.col(CORRUPT).isNotNull(), F.col(CORRUPT)).otherwise(F.to_json(F.struct(*fields)))
    return scanned.select(F.col("arrival.file_path").alias("file"), "arrival.split", "arrival.row", body.alias("record"),
                          reject_reason().alias("reason")).filter(F.col("reason").isNotNull())


def landing_rejects(spark: SparkSession, path: str, fmt: str = "json", array: bool | None = None) -> DataFrame:
    """A1: one row (records, rejects, named): records of a landing, the malformed ones
    among them, and those that name a repository."""
    return scan_landing(spark, path, fmt, array).agg(
        F.count("arrival").cast("bigint").alias("records"),
        F.count_if(F.col(CORRUPT).isNotNull()).cast("bigint").alias("rejects"),
        F.count_if(F.col("repo_name").isNotNull()).cast("bigint").alias("named"))


def write_landing(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """A2: write landing rows, keeping null keys (JSON drops them by default)."""
    cols = [c for c in LANDING_FIELDS + ["seq"] if c in df.columns]
    w = df.select(*cols).write.mode(mode)
    if fmt == "parquet":
        w.parquet(path)
    else:
        w.option("ignoreNullFields", False).json(path)


def append_landing(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A3: complete rows (signals already computed in the same select) are
    appended; nothing already written is patched."""
    write_landing(df, path, fmt, mode="append")


def decode_contents(df: DataFrame, b64_col: str = "content_b64", out_col: str = "content") -> DataFrame:
    """A5: base64 -> strict UTF-8; rows whose text decodes to null or '' are
    dropped (the original skips empty downloads)."""
    from quarry.functions.text import decode_content
    out = df.withColumn(out_col, decode_content(F.col(b64_col)))
    return out.filter(F.col(out_col).isNotNull() & (F.length(out_col) > 0))


def read_text_files(spark: SparkSession, path: str, repo_full_name: str | None = None) -> DataFrame:
    """Source files as (path, content) read leniently (invalid bytes
    dropped). Note Spark's file sources skip names starting with '_' or '.',
    so files such as __init__.py must be landed as rows, not loose files."""
    from quarry.functions.text import lenient_text
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = raw.select(F.col("path").alias("source_path"), lenient_text(F.col("content")).alias("content"))
    if repo_full_name is not None:
        out = out.withColumn("repo_full_name", F.lit(repo_full_name))
    return out
