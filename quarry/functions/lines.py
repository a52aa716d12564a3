"""Line-level text expressions: universal-newline split, Python-style strip,
and the code-line count (C1) as a single array fold — no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: Unicode White_Space plus \x1c-\x1f.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")

TRIPLE_DQ = '"""'
TRIPLE_SQ = "'''"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_lines(text) -> Column:
    """array<string> of the lines of `text` (keeps a trailing empty element).
    Universal newlines: \\r\\n, \\r and \\n end a line; nothing else does."""
    # one kind of line end first: a single character is split without the regular expression engine
    unix = F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(unix, "\n", -1)


def py_strip(line) -> Column:
    return F.btrim(_c(line), F.lit(PY_WHITESPACE))


def occurrences(s: Column, needle: str) -> Column:
    """Non-overlapping occurrences of `needle` in `s` (as str.count)."""
    return (F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / F.lit(len(needle))


def code_line_count(text) -> Column:
    """Lines that are code: not blank, not a `#` comment, not part of a
    triple-quoted block. A line holding a triple quote never counts; it toggles
    the block flag unless one quote style occurs exactly twice on it.
    Null text (missing file) counts 0."""
    return code_line_count_of_lines(split_lines(text))


def code_line_count_of_lines(raw_lines) -> Column:
    """`code_line_count` over an already split array<string> of raw lines."""
    # only how a line begins and the quotes on it count: white space at its end is left alone
    lines = F.transform(_c(raw_lines), lambda l: F.ltrim(l, F.lit(PY_WHITESPACE)))

    # the state is one number: twice the lines counted, plus 1 inside a block
    def step(acc, line):
        has_q = line.contains(TRIPLE_DQ) | line.contains(TRIPLE_SQ)
        paired = (occurrences(line, TRIPLE_DQ) == 2) | (occurrences(line, TRIPLE_SQ) == 2)
        return (F.when(line == "", acc)
                .when(has_q & paired, acc)
                .when(has_q, acc.bitwiseXOR(F.lit(1).cast("bigint")))
                .when(acc.bitwiseAND(F.lit(1).cast("bigint")) == 1, acc)
                .when(line.startswith("#"), acc)
                .otherwise(acc + 2))

    zero = F.lit(0).cast("bigint")
    return F.coalesce(F.aggregate(lines, zero, step, lambda acc: F.shiftright(acc, 1)), zero)


def ends_line(text) -> Column:
    """Whether the last character of `text` is a line end."""
    return _c(text).endswith("\n") | _c(text).endswith("\r")


def line_count(text, raw_lines=None) -> Column:
    """Number of lines as a line reader yields them (0 for empty text)."""
    t = _c(text)
    lines = split_lines(t) if raw_lines is None else _c(raw_lines)
    ends_nl = ends_line(t)
    return (F.when(t.isNull() | (t == ""), F.lit(0))
            .otherwise(F.size(lines) - F.when(ends_nl, 1).otherwise(0))).cast("bigint")
