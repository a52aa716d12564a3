"""Per-file quality signals as column expressions: licence rule (B2), native
lint findings and score (C2), rating extraction (C4), block-complexity
summary (E8), and Python-compatible number formatting for reason texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lines import ends_line, line_count, split_lines
from quarry.schema import ALLOWED_LICENSES, RATING_PATTERN, LintRules


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- B2 licence compatibility ---------------------------------------------

def license_ok(license_col, allowed=ALLOWED_LICENSES, accept_null: bool = True) -> Column:
    """Null passes (when accepted); exact member passes; otherwise an allowed
    name must occur inside the licence text (case-sensitive). '' fails."""
    lic = _c(license_col)
    allowed = [a for a in allowed if a is not None]
    hit = reduce(lambda acc, a: acc | lic.contains(a), allowed, F.lit(False))
    ok = lic.isin(allowed) | hit
    if accept_null:
        return F.when(lic.isNull(), F.lit(True)).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


# --- C2 native lint signals --------------------------------------------------

def lint_counts(text, rules: LintRules = LintRules(), raw_lines=None) -> Column:
    """struct of convention/warning finding counts for one file, computed with
    array folds over the file's lines (no explode, no shuffle).
    `raw_lines` may name an already split line array of `text`.

    Per line: longer than the limit, trailing space/tab (C); a `#` comment
    naming FIXME/TODO/XXX (W, the regex only runs on lines holding `#`).
    Per file: missing final newline, trailing blank lines, too many lines (C)."""
    t = _c(text)
    raw = split_lines(t) if raw_lines is None else _c(raw_lines)
    zero = F.lit(0).cast("bigint")
    # a line has no more characters than bytes, whose number is at hand
    per_line_conv = F.aggregate(raw, zero, lambda acc, l: acc
                                + F.when((F.octet_length(l) > rules.max_line_length) & (F.length(l) > rules.max_line_length), 1).otherwise(0)
                                + F.when(l.endswith(" ") | l.endswith("\t"), 1).otherwise(0))
    missing_final_nl = F.when((t != "") & ~ends_line(t), 1).otherwise(0)
    # two line ends with only spaces and tabs between and after them; \r\n by itself has two
    blank = lambda l: F.ltrim(l, F.lit(" \t")) == ""
    n, last = F.size(raw), F.get(raw, F.size(raw) - 1)
    trailing_nls = F.when(blank(last) & (((n > 2) & blank(F.get(raw, n - 2))) | t.endswith(F.concat(F.lit("\r\n"), last))), 1).otherwise(0)
    too_many = F.when(line_count(t, raw) > rules.max_module_lines, 1).otherwise(0)
    if rules.check_fixme:
        words = lambda s: s.contains("FIXME") | s.contains("TODO") | s.contains("XXX")
        fixme = F.when(words(t), F.aggregate(raw, zero, lambda acc, l: acc + F.when(
            l.contains("#") & words(l) & l.rlike(r"#.*\b(FIXME|TODO|XXX)\b"), 1).otherwise(0))).otherwise(zero)
    else:
        fixme = zero
    conv = per_line_conv + missing_final_nl + trailing_nls + too_many
    return F.struct(
        F.coalesce(conv, F.lit(0)).cast("bigint").alias("convention"),
        F.coalesce(fixme, F.lit(0)).cast("bigint").alias("warning"),
        F.lit(0).cast("bigint").alias("error"),
        F.lit(0).cast("bigint").alias("refactor"),
    )


def raw_lint_score(counts: Column, statements) -> Column:
    """10 - 10*(5E + W + R + C)/statements, unclamped; null when no statements."""
    stmts = _c(statements)
    weighted = counts["error"] * 5 + counts["warning"] + counts["refactor"] + counts["convention"]
    return F.when(stmts > 0, F.lit(10.0) - (weighted * 10) / stmts)


def lint_score(counts: Column, statements) -> Column:
    """Clamped score in [0, 10]; files without statements score 0.0."""
    return F.coalesce(F.greatest(F.lit(0.0), raw_lint_score(counts, statements)), F.lit(0.0))


def extract_rating(report) -> Column:
    """C4: rating parsed from a lint report; negative -> 0; absent -> 0.0."""
    val = F.regexp_extract(_c(report), RATING_PATTERN, 1)
    num = F.when(val == "", None).otherwise(val).try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), num), F.lit(0.0))


def format_rating_report(score_hundredths) -> Column:
    """Lint report line for a score given in integer hundredths."""
    h = _c(score_hundredths)
    sign = F.when(h < 0, "-").otherwise("")
    a = F.abs(h)
    return F.concat(F.lit("Your code has been rated at "), sign, (a / 100).cast("bigint").cast("string"),
                    F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"), F.lit("/10"))


# --- E8 block complexity summary ---------------------------------------------

def complexity_summary(block_complexities) -> Column:
    """struct(avg_complexity, function_count, max_complexity) over an
    array<int>; an empty or null array gives zeros."""
    arr = F.coalesce(_c(block_complexities), F.array().cast("array<bigint>"))
    n = F.size(arr).cast("bigint")
    total = F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return F.struct(
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("avg_complexity"),
        n.alias("function_count"),
        F.coalesce(F.array_max(arr).cast("bigint"), F.lit(0).cast("bigint")).alias("max_complexity"),
    )


# --- rounding / number formatting -------------------------------------------

def round2(x) -> Column:
    """Round to 2 places as round(x*100)/100, ties away from zero — the SQL
    engines' double rounding. It equals Python's round() except where the
    product x*100 is (or rounds to) exactly k+0.5, e.g. 2.675 -> 2.68 here,
    2.67 in Python. Unlike Spark's round(x, 2) it does not depend on the
    decimal text of x (that would round 2.445, binary 2.44499.., up)."""
    return F.round(_c(x) * F.lit(100.0)) / F.lit(100.0)


def py_fixed1(x) -> Column:
    """'%.1f' of a double exactly as Python formats it: the binary value is
    rounded half-to-even. 10*x is split into a rounded sum and its exact error
    (TwoSum), so ties and near-ties are decided on the exact value."""
    x = _c(x).cast("double")
    a = x * F.lit(8.0)
    b = x * F.lit(2.0)
    s = a + b
    bb = s - a
    err = (a - (s - bb)) + (b - bb)
    n = F.floor(s)
    frac = s - n
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
          .when(err > 0, True).when(err < 0, False)
          .otherwise(F.pmod(n, F.lit(2)) == 1))
    m = n + F.when(up, 1).otherwise(0)
    am = F.abs(m)
    neg = (m < 0) | ((m == 0) & (x < 0))
    return F.concat(F.when(neg, "-").otherwise(""), (am / 10).cast("bigint").cast("string"),
                    F.lit("."), (am % 10).cast("string"))


def py_str_float(v: float) -> str:
    """Python's str() of a float threshold, computed on the driver."""
    return str(float(v))
