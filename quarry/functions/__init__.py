"""Column expressions used by the operators."""

from quarry.functions.lines import code_line_count, line_count, py_strip, split_lines
from quarry.functions.signals import (
    complexity_summary, extract_rating, format_rating_report, license_ok, lint_counts,
    lint_score, py_fixed1, raw_lint_score,
)
from quarry.functions.text import (
    basename, bool_to_int, decode_content, dirname, int_to_bool, landing_path, lenient_text,
    or_unknown, or_zero, parse_iso, parse_repo_url, path_depth, preview,
)

__all__ = [
    "code_line_count", "line_count", "py_strip", "split_lines",
    "complexity_summary", "extract_rating", "format_rating_report", "license_ok", "lint_counts",
    "lint_score", "py_fixed1", "raw_lint_score",
    "basename", "bool_to_int", "decode_content", "dirname", "int_to_bool", "landing_path",
    "lenient_text", "or_unknown", "or_zero", "parse_iso", "parse_repo_url", "path_depth", "preview",
]
