"""Signals and the suitability verdict.

All of it is row-local column arithmetic without a shuffle (the folds over lines
are higher-order functions, which Spark interprets inside the stage), so it scales
linearly with the corpus and never moves text across the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema as S
from quarry.functions.lines import code_line_count_of_lines, split_lines
from quarry.functions.signals import license_ok, lint_counts, lint_score, py_fixed1, py_str_float, round2
from quarry.schema import Thresholds


def _fill(template: str, *values: Column) -> Column:
    """Fill the `{}` holes of a fixed reason template with column values."""
    pieces = template.split("{}")
    assert len(pieces) == len(values) + 1, template
    out = [F.lit(pieces[0])]
    for v, p in zip(values, pieces[1:]):
        out += [v, F.lit(p)]
    return F.concat(*out)


def add_signals(df: DataFrame, text_col: str = "content", th: Thresholds = Thresholds(),
                external_score: str | None = None) -> DataFrame:
    """Add code_lines, lint_findings, quality_score_raw (clamped, unrounded) and
    quality_score (rounded to 2 places). An external score column, when given
    and non-null, replaces the native lint score."""
    # split once; both signals read the same line array
    out = df.withColumn("_lines", split_lines(text_col))
    out = out.withColumns({
        "code_lines": F.when(F.col(text_col).isNull(), F.lit(0).cast("bigint"))
                       .otherwise(code_line_count_of_lines(F.col("_lines"))),
        "lint_findings": lint_counts(text_col, th.lint, F.col("_lines"))}).drop("_lines")
    native = F.when(F.col(text_col).isNull(), F.lit(0.0)).otherwise(
        lint_score(F.col("lint_findings"), F.col("code_lines")))
    score = native if external_score is None else F.coalesce(F.col(external_score), native)
    return (out.withColumn("quality_score_raw", score)
               .withColumn("quality_score", round2(F.col("quality_score_raw"))))


def add_signals_with_ast(df: DataFrame, text_col: str = "content", th: Thresholds = Thresholds()) -> DataFrame:
    """C2 with the AST rules and C3: native findings plus the AST pass's
    findings (E: syntax error; W: broad except, wildcard / unused import;
    R: too many arguments / branches / statements), scored over the AST's
    statement count; adds `complexity` and `blocks`. The text goes through
    Python once (Arrow); every other column is passed through."""
    from quarry.operators.complexity import analyze_ast, with_complexity
    s = add_signals(df, text_col, th).withColumn("_present", F.col(text_col).isNotNull())
    keep = [c for c in s.columns if c != text_col]
    a = with_complexity(analyze_ast(s, keep, text_col))
    lf = F.col("lint_findings")
    counts = F.struct(lf["convention"].alias("convention"),
                      (lf["warning"] + F.col("ast_warnings")).alias("warning"),
                      F.col("ast_errors").alias("error"),
                      F.col("ast_refactors").alias("refactor"))
    stmts = F.when(F.col("parse_ok"), F.col("statements")).otherwise(F.lit(0))
    score = F.when(~F.col("_present"), F.lit(0.0)).otherwise(lint_score(counts, stmts))
    # one projection: `counts` and `score` both read the native `lint_findings`
    return (a.withColumns({"lint_findings": counts, "quality_score_raw": score})
             .withColumn("quality_score", round2(F.col("quality_score_raw"))))


def verdict_columns(th: Thresholds, present: Column, license_col: Column, lines: Column,
                    score: Column) -> dict[str, Column]:
    """First failing rule wins: missing file, licence, too few lines, too many
    lines, low score. A null score counts as 0.0."""
    sc = F.coalesce(score, F.lit(0.0))
    lic_ok = license_ok(license_col, th.allowed_licenses, th.accept_null_license)
    code = (F.when(~present, S.RC_MISSING)
            .when(~lic_ok, S.RC_LICENSE)
            .when(lines < th.min_lines, S.RC_TOO_SHORT)
            .when(lines > th.max_lines, S.RC_TOO_LONG)
            .when(sc < th.min_quality, S.RC_LOW_QUALITY)
            .otherwise(S.RC_OK))
    lines_s = lines.cast("string")
    reason = (F.when(code == S.RC_MISSING, F.lit(S.REASON_MISSING))
              .when(code == S.RC_LICENSE, _fill(S.REASON_LICENSE, F.coalesce(license_col, F.lit("None"))))
              .when(code == S.RC_TOO_SHORT, _fill(S.REASON_TOO_SHORT, lines_s, F.lit(str(th.min_lines))))
              .when(code == S.RC_TOO_LONG, _fill(S.REASON_TOO_LONG, lines_s, F.lit(str(th.max_lines))))
              .when(code == S.RC_LOW_QUALITY,
                    _fill(S.REASON_LOW_QUALITY, py_fixed1(sc), F.lit(py_str_float(th.min_quality)))))
    return {"reason_code": code, "is_suitable": code == S.RC_OK, "unsuitable_reason": reason}


def apply_verdict(df: DataFrame, th: Thresholds = Thresholds(), text_col: str = "content",
                  license_col: str = "repo_license") -> DataFrame:
    """Verdict per file. Expects signal columns from `add_signals`.
    `unsuitable_reason` is null for suitable files."""
    cols = verdict_columns(th, F.col(text_col).isNotNull(), F.col(license_col),
                           F.col("code_lines"), F.col("quality_score_raw"))
    return df.withColumns(cols)


def score_and_judge(df: DataFrame, th: Thresholds = Thresholds(), text_col: str = "content",
                    license_col: str = "repo_license", external_score: str | None = None,
                    with_ast: bool = False) -> DataFrame:
    """Signals + verdict. With `with_ast` the score includes the AST rules and
    the rows carry complexity (one Arrow pass over the text)."""
    if not with_ast:
        return apply_verdict(add_signals(df, text_col, th, external_score), th, text_col, license_col)
    s = add_signals_with_ast(df, text_col, th)
    cols = verdict_columns(th, F.col("_present"), F.col(license_col), F.col("code_lines"), F.col("quality_score_raw"))
    return s.withColumns(cols).drop("_present")


#: what `score_contents` says of a text; `error` tells why it could not be analysed
SIGNALS = ["code_lines", "quality_score_raw", "quality_score", "complexity", "error", "_present"]


def score_contents(contents: DataFrame, th: Thresholds = Thresholds(), key: str = "local_path") -> DataFrame:
    """Signals of each stored text, without the text: (key, *SIGNALS). Row-local; the
    complexity pass gets the text and these few columns through Arrow. Of several texts under one
    key one row stays (the least by its signals, so the choice is defined)."""
    from quarry.operators.complexity import analyze_ast, with_complexity
    narrow = [key, "_present", "code_lines", "quality_score_raw", "quality_score"]
    s = add_signals(contents.select(key, "content").withColumn("_present", F.col("content").isNotNull()), "content", th)
    a = with_complexity(analyze_ast(s.select(*narrow, "content"), narrow, "content")).withColumn("error", F.col("ast_failure"))
    return a.groupBy(key).agg(F.min(F.struct(*SIGNALS)).alias("s")).select(key, "s.*")


def judged_columns(th: Thresholds, present: Column) -> dict[str, Column]:
    """Verdict columns of rows with SIGNALS. A file that could not be analysed has no score and
    no verdict, 0 lines, and its failure as the reason."""
    cols = verdict_columns(th, present, F.col("repo_license"), F.col("code_lines"), F.col("quality_score_raw"))
    failed = F.col("error").isNotNull()
    no = lambda kind: F.lit(None).cast(kind)
    return {"reason_code": F.when(failed, F.lit(S.RC_FAILED)).otherwise(cols["reason_code"]),
            "is_suitable": F.when(failed, no("boolean")).otherwise(cols["is_suitable"]),
            "unsuitable_reason": F.when(failed, _fill(S.REASON_FAILED, F.col("error"))).otherwise(cols["unsuitable_reason"]),
            "quality_score": F.when(failed, no("double")).otherwise(F.col("quality_score")),
            "quality_score_raw": F.when(failed, no("double")).otherwise(F.col("quality_score_raw")),
            "code_lines": F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("code_lines")),
            "complexity": F.when(~failed, F.col("complexity"))}


def judge_landing(landing: DataFrame, signals: DataFrame, th: Thresholds = Thresholds(), key: str = "local_path") -> DataFrame:
    """B4 from signals: rows without `key` are skipped; the rest get quality_score, code_lines, complexity,
    is_suitable and unsuitable_reason. A path without signals is a missing text, which is a verdict."""
    rows = landing.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    kept = [c for c in rows.columns if c not in ("quality_score", "code_lines", "complexity", "is_suitable", "unsuitable_reason")]
    j = rows.select(*kept).join(signals, key, "left")
    zero = F.struct(F.lit(0.0).alias("avg_complexity"), F.lit(0).cast("bigint").alias("function_count"),
                    F.lit(0).cast("bigint").alias("max_complexity"))
    j = j.withColumns({"code_lines": F.coalesce("code_lines", F.lit(0).cast("bigint")),
                       "quality_score": F.coalesce("quality_score", F.lit(0.0)),
                       "quality_score_raw": F.coalesce("quality_score_raw", F.lit(0.0)),
                       "complexity": F.coalesce("complexity", zero)})
    return j.withColumns(judged_columns(th, F.coalesce("_present", F.lit(False)))).drop("_present", "error")


def wanted_texts(landing: DataFrame, contents: DataFrame, key: str = "local_path") -> DataFrame:
    """The texts that a landing names: keys are joined first, other texts are not looked at."""
    return contents.select(key, "content").join(landing.select(key).filter(f"{key} <> ''").distinct(), key, "left_semi")


def filter_landing(landing: DataFrame, contents: DataFrame, th: Thresholds = Thresholds(),
                   key: str = "local_path") -> DataFrame:
    """B4 over landing rows: rows without `local_path` are skipped; the rest
    get quality_score, code_lines, complexity, is_suitable, unsuitable_reason from their
    text (`contents` holds local_path, content). Missing text is a verdict. Texts that no row names are not scored;
    the others are scored where they lie, and only their signals are joined to the landing.
    `sources.texts.cached_scores` with `judge_landing` scores each distinct text once over many landings."""
    return judge_landing(landing, score_contents(wanted_texts(landing, contents, key), th, key), th, key)


def suitable(df: DataFrame) -> DataFrame:
    """Verdict true; null or absent verdict is unsuitable."""
    return df.filter(F.coalesce(F.col("is_suitable"), F.lit(False)))


def unsuitable(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("is_suitable"), F.lit(False)))


def verdict_counts(df: DataFrame) -> DataFrame:
    """One row (suitable, unsuitable)."""
    flag = F.coalesce(F.col("is_suitable"), F.lit(False))
    return df.agg(F.count_if(flag).cast("bigint").alias("suitable"),
                  F.count_if(~flag).cast("bigint").alias("unsuitable"))


def reason_breakdown(df: DataFrame) -> DataFrame:
    """Files per verdict reason (partial aggregation before the shuffle)."""
    return df.groupBy("reason_code").agg(F.count(F.lit(1)).cast("bigint").alias("files"))
