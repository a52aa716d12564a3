"""Schemas, thresholds and the fixed values that results must reproduce."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original tool's for identical results)
# ---------------------------------------------------------------------------
# Licences accepted as learning material. A missing licence (null) is accepted too.
ALLOWED_LICENSES = (
    "MIT License",
    "Apache License 2.0",
    "BSD License",
    "GNU General Public License v3.0",
    "GNU Lesser General Public License v3.0",
)
ACCEPT_NULL_LICENSE = True

# Verdict thresholds: minimum score 6.0, code lines within [10, 1000].
DEFAULT_MIN_QUALITY = 6.0
DEFAULT_MIN_LINES = 10
DEFAULT_MAX_LINES = 1000

# Reason texts of the verdict, in rule order. `{}` holes are filled with
# the licence / line count / score and the threshold, as the original prints them.
REASON_MISSING = "파일이 존재하지 않음"
REASON_LICENSE = "라이센스 호환성 문제 ({})"
REASON_TOO_SHORT = "코드 라인 수 부족 ({} < {})"
REASON_TOO_LONG = "코드 라인 수 초과 ({} > {})"
REASON_LOW_QUALITY = "품질 점수 미달 ({} < {})"
REASON_FAILED = "분석 오류: {}"

# Header of the filtered report export (CSV), in column order.
REPORT_HEADER = ("ID", "파일명", "저장소", "품질 점수", "코드 라인", "적합성", "태그", "로컬 경로")

# Lint report line from which a rating is parsed.
RATING_PATTERN = r"Your code has been rated at ([-\d.]+)/10"

# Score histogram bins: [0,2) [2,4) [4,6) [6,8) [8,inf); below 0 falls in bin 0.
SCORE_BIN_EDGES = (2.0, 4.0, 6.0, 8.0)

# Result caps of the original front ends.
SEARCH_LIMIT = 100
CLI_SEARCH_LIMIT = 20
TOP_LIST_LIMIT = 10
JOB_HISTORY_LIMIT = 10

# Job states.
JOB_IN_PROGRESS = "in_progress"
JOB_COMPLETED = "completed"
JOB_FAILED = "failed"

# Host that repository URLs must name.
DEFAULT_REPO_HOST = "github.com"
# ---------------------------------------------------------------------------

# Verdict reason codes (ours; stable keys for grouping).
RC_MISSING = "missing_file"
RC_LICENSE = "license"
RC_TOO_SHORT = "too_few_lines"
RC_TOO_LONG = "too_many_lines"
RC_LOW_QUALITY = "low_quality"
RC_FAILED = "analysis_failed"
RC_OK = "ok"


@dataclass(frozen=True)
class LintRules:
    """Native lint rule parameters (weights follow the usual 5E+W+R+C formula)."""

    max_line_length: int = 100
    max_module_lines: int = 1000
    check_fixme: bool = True


@dataclass(frozen=True)
class Thresholds:
    min_quality: float = DEFAULT_MIN_QUALITY
    min_lines: int = DEFAULT_MIN_LINES
    max_lines: int = DEFAULT_MAX_LINES
    allowed_licenses: tuple = ALLOWED_LICENSES
    accept_null_license: bool = ACCEPT_NULL_LICENSE
    lint: LintRules = field(default_factory=LintRules)

    def __post_init__(self):
        object.__setattr__(self, "min_quality", float(self.min_quality))
        object.__setattr__(self, "min_lines", int(self.min_lines))
        object.__setattr__(self, "max_lines", int(self.max_lines))
        object.__setattr__(self, "allowed_licenses", tuple(self.allowed_licenses))


COMPLEXITY_TYPE = T.StructType([
    T.StructField("avg_complexity", T.DoubleType()),
    T.StructField("function_count", T.LongType()),
    T.StructField("max_complexity", T.LongType()),
])

# Landing metadata: every key optional; later stages add the signal keys.
LANDING_SCHEMA = T.StructType([
    T.StructField("repo_name", T.StringType()),
    T.StructField("repo_full_name", T.StringType()),
    T.StructField("repo_url", T.StringType()),
    T.StructField("repo_stars", T.LongType()),
    T.StructField("repo_license", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_url", T.StringType()),
    T.StructField("local_path", T.StringType()),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("downloaded_at", T.StringType()),
    T.StructField("code_lines", T.LongType()),
    T.StructField("complexity", COMPLEXITY_TYPE),
    T.StructField("is_suitable", T.BooleanType()),
    T.StructField("unsuitable_reason", T.StringType()),
])

LANDING_FIELDS = [f.name for f in LANDING_SCHEMA.fields]

TAG_OPS_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("tag", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("seq", T.LongType()),
])

JOB_EVENT_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("query", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("files_downloaded", T.LongType()),
    T.StructField("suitable_files", T.LongType()),
    T.StructField("unsuitable_files", T.LongType()),
    T.StructField("error", T.StringType()),
])

REPO_LISTING_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("stars", T.LongType()),
    T.StructField("forks", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("license", T.StringType()),
])

FILE_LISTING_SCHEMA = T.StructType([
    T.StructField("repo_full_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("sha", T.StringType()),
    T.StructField("size", T.LongType()),
])
