"""AST pass (C3 + AST lint findings): the only per-file Python in the engine.

Python source must be parsed by Python, so this is one `mapInArrow` over
(key, text) rows — Spark partitions and schedules it, the
helper below only walks one tree. Key columns pass through as Arrow arrays, and a worker holds the
texts and results of SLICE rows at a time, however many rows a batch has. It yields, per file, the flat block list
(module functions, classes, methods) with cyclomatic complexity, plus counts
of AST lint findings and statements. Everything after it (E8 summary, score,
verdict) is native again.

Complexity of a function = 1 + if / conditional expression / assert
+ for / while (+1 with else) + except handlers (+1 with else)
+ (boolean operands - 1) + comprehensions (1 + their ifs)
+ match cases (a trailing wildcard case not counted). Nested functions are
not added to their parent. Functions and classes under a module's or class's
compound statements (`if`, `try`, `with`, loops) are its blocks. A class counts int((1 + sum(methods)) / n) +
(n > 1) for n methods, or 1 + its own branches when it has none.
Unparsable text gives no blocks (zeros downstream). A text that the parser gives up on (nested too
deeply, out of memory) is a failure of its own: `ast_failure` tells it, and the other rows of the batch go on.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.signals import complexity_summary

AST_FIELDS = [
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("block_names", T.ArrayType(T.StringType())),
    T.StructField("block_kinds", T.ArrayType(T.StringType())),
    T.StructField("block_complexities", T.ArrayType(T.LongType())),
    T.StructField("statements", T.LongType()),
    T.StructField("ast_errors", T.LongType()),
    T.StructField("ast_warnings", T.LongType()),
    T.StructField("ast_refactors", T.LongType()),
    T.StructField("ast_failure", T.StringType()),
]

# AST lint rule limits (the linter's documented defaults).
MAX_ARGS = 5
MAX_BRANCHES = 12
MAX_STATEMENTS = 50
BROAD_EXCEPTIONS = ("Exception", "BaseException")
# Rows whose texts and results are Python objects at once.
SLICE = 128

_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCH_STMTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)
# Fields that hold operators, contexts, names or flags: nothing that is counted lies below them.
_PLAIN_FIELDS = frozenset((
    "arg", "asname", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "names",
    "op", "ops", "rest", "simple", "type_comment"))
_NODE_TYPES: dict = {}


def _decision_points(node: ast.AST) -> int:
    t = type(node)
    if t in (ast.If, ast.IfExp, ast.Assert):
        return 1
    if t in (ast.For, ast.AsyncFor, ast.While):
        return 1 + bool(node.orelse)
    if t is ast.Try or t.__name__ == "TryStar":
        return len(node.handlers) + bool(node.orelse)
    if t is ast.BoolOp:
        return len(node.values) - 1
    if t is ast.comprehension:
        return 1 + len(node.ifs)
    if t.__name__ == "Match":
        cases = node.cases
        wildcard = bool(cases) and isinstance(cases[-1].pattern, ast.MatchAs) and cases[-1].pattern.pattern is None
        return len(cases) - wildcard
    return 0


def _node_type(t: type) -> tuple:
    """What the traversal needs of a node type: the fields with children (last first), whether it is a statement,
    may hold decision points or is a branch, and whether its fields mean something by themselves."""
    special = t in (ast.ExceptHandler, ast.ImportFrom, ast.Import, ast.ClassDef, *_FUNCS)
    points = t in (ast.If, ast.IfExp, ast.Assert, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.BoolOp, ast.comprehension) \
        or t.__name__ in ("TryStar", "Match")
    fields = tuple(f for f in reversed(t._fields) if f not in _PLAIN_FIELDS)
    _NODE_TYPES[t] = info = (fields, issubclass(t, ast.stmt), points, t in _BRANCH_STMTS, special)
    return info


def _scan(tree: ast.Module):
    """One traversal: blocks with complexity, statements, AST findings.

    Decision points go to the innermost function or class scope. Blocks are
    module functions, classes (also nested in classes) and their methods. Names and constants have no
    children and are not visited."""
    blocks: list = []          # [name, kind, scope]
    funcs: list = []
    statements = warnings = 0
    imported: set = set()
    used: set = set()
    types, name, constant, node_base = _NODE_TYPES, ast.Name, ast.Constant, ast.AST
    # (node, scope, block context): context is ("module", "", None), ("class", "C.", class_scope) or None
    stack = [(n, None, ("module", "", None)) for n in reversed(tree.body)]
    pop, push = stack.pop, stack.append
    while stack:
        node, scope, ctx = pop()
        t = type(node)
        fields, is_stmt, points, is_branch, special = types.get(t) or _node_type(t)
        if is_stmt:
            statements += 1
        if scope is not None:
            if is_stmt and scope["func"]:
                scope["stmts"] += 1
            if points:
                scope["cx"] += _decision_points(node)
            if is_branch and scope["func"]:
                scope["branches"] += 1
        # compound statements of a module or class hold its blocks too; a function's insides hold none
        child_scope, child_ctx = scope, ctx
        if special:
            if t is ast.ExceptHandler:
                if node.type is None or (isinstance(node.type, ast.Name) and node.type.id in BROAD_EXCEPTIONS):
                    warnings += 1
            elif t is ast.ImportFrom:
                for a in node.names:
                    if a.name == "*":
                        warnings += 1
                    else:
                        imported.add(a.asname or a.name)
            elif t is ast.Import:
                for a in node.names:
                    imported.add((a.asname or a.name).split(".")[0])
            elif t is ast.ClassDef:
                child_scope = {"func": False, "cx": 0, "methods": []}
                if ctx is not None:
                    full = ctx[1] + node.name
                    blocks.append([full, "class", child_scope])
                    child_ctx = ("class", full + ".", child_scope)
            else:
                child_ctx = None
                a = node.args
                child_scope = {"func": True, "cx": 0, "branches": 0, "stmts": 0,
                               "nargs": len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs)}
                funcs.append(child_scope)
                if ctx is not None:
                    if ctx[0] == "module":
                        blocks.append([node.name, "function", child_scope])
                    else:
                        blocks.append([ctx[1] + node.name, "method", child_scope])
                        ctx[2]["methods"].append(child_scope)
        for f in fields:
            child = getattr(node, f, None)
            if type(child) is list:
                for c in reversed(child):
                    k = type(c)
                    if k is name:
                        used.add(c.id)
                    elif k is not constant and isinstance(c, node_base):
                        push((c, child_scope, child_ctx))
            elif child is not None:
                k = type(child)
                if k is name:
                    used.add(child.id)
                elif k is not constant and isinstance(child, node_base):
                    push((child, child_scope, child_ctx))

    def cx(kind, sc):
        if kind != "class":
            return 1 + sc["cx"]
        ms = sc["methods"]
        if not ms:
            return 1 + sc["cx"]
        return int((1 + sum(1 + m["cx"] for m in ms)) / len(ms)) + (len(ms) > 1)

    out = [(name, kind, cx(kind, sc)) for name, kind, sc in blocks]
    refactors = sum((f["nargs"] > MAX_ARGS) + (f["branches"] > MAX_BRANCHES) + (f["stmts"] > MAX_STATEMENTS)
                    for f in funcs)
    warnings += len(imported - used)
    return out, statements, warnings, refactors


def analyze_source(text: str | None) -> dict:
    """Per-file helper: parse and summarise one source text."""
    empty = {"parse_ok": False, "block_names": [], "block_kinds": [], "block_complexities": [],
             "statements": 0, "ast_errors": 0, "ast_warnings": 0, "ast_refactors": 0, "ast_failure": None}
    if text is None:
        return empty
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return {**empty, "ast_errors": 1}
    except (RecursionError, MemoryError) as e:
        return {**empty, "ast_errors": 1, "ast_failure": type(e).__name__}
    blocks, st, w, r = _scan(tree)
    return {"parse_ok": True, "block_names": [b[0] for b in blocks], "block_kinds": [b[1] for b in blocks],
            "block_complexities": [b[2] for b in blocks], "statements": st, "ast_errors": 0,
            "ast_warnings": w, "ast_refactors": r, "ast_failure": None}


def _ship_by_value() -> None:
    """Pickle this module's helpers by value, so executors run the AST pass
    without `quarry` installed on them (no --py-files needed)."""
    import sys

    from pyspark import cloudpickle
    mod = sys.modules[__name__]
    try:
        cloudpickle.register_pickle_by_value(mod)
    except ValueError:  # already registered
        pass


def analyzed(batches, key_cols: list[str], text_col: str, types: dict):
    """Key columns and results of Arrow batches, SLICE rows at a time."""
    for whole in batches:
        texts, keys = whole.schema.get_field_index(text_col), [whole.schema.get_field_index(k) for k in key_cols]
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            res = [analyze_source(t.as_py()) for t in batch.column(texts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keys), *(pa.array([r[n] for r in res], kind) for n, kind in types.items())],
                names=[*key_cols, *types])


def analyze_ast(df: DataFrame, key_cols: list[str], text_col: str = "content") -> DataFrame:
    """One row per input row with the AST columns added (key columns kept).
    Only the key and text columns cross into Python; what a worker holds at once does not grow with the batch."""
    _ship_by_value()
    keys = [df.schema[k] for k in key_cols]
    schema = T.StructType(keys + AST_FIELDS)
    types = {f.name: to_arrow_type(f.dataType) for f in AST_FIELDS}

    return df.select(*dict.fromkeys([*key_cols, text_col])).mapInArrow(lambda batches: analyzed(batches, key_cols, text_col, types), schema)


def with_complexity(ast_df: DataFrame) -> DataFrame:
    """E8 on the AST output: the nested complexity record and the block list."""
    blocks = F.arrays_zip(F.col("block_names").alias("name"), F.col("block_kinds").alias("kind"),
                          F.col("block_complexities").alias("complexity"))
    return ast_df.withColumn("complexity", complexity_summary(F.col("block_complexities"))) \
                 .withColumn("blocks", blocks)
