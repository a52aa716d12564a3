"""A1-A3, A5, A7, A9-A12 sources and sinks; A13/A14/B14/G5 repositories; C3 AST pass."""

import base64
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import basename, decode_content, dirname, landing_path, parse_repo_url, preview
from quarry.operators import repos as RP
from quarry.operators.complexity import analyze_ast, analyze_source, with_complexity
from quarry.schema import REPO_LISTING_SCHEMA
from quarry.sources import exports as X
from quarry.sources import landing as L
from quarry.sources import tables as TB


def tmp():
    return tempfile.mkdtemp(prefix="quarry-t-")


def test_landing_roundtrip_keeps_nulls(spark):
    df = spark.createDataFrame([("o/r", None, 1)], "repo_full_name string, repo_license string, seq long")
    d = tmp() + "/landing"
    L.write_landing(df, d)
    raw = "".join(open(os.path.join(d, f)).read() for f in sorted(os.listdir(d)) if f.endswith(".json"))
    assert '"repo_license":null' in raw
    back = L.read_landing(spark, d)
    assert back.drop("arrival").schema == L.SEQ_SCHEMA and back.count() == 1
    assert L.read_landing(spark, tmp() + "/missing").count() == 0
    L.append_landing(df, d)
    assert L.read_landing(spark, d).count() == 2


def test_landing_json_array(spark):
    p = tmp() + "/meta.json"
    with open(p, "w") as f:
        f.write('[{"repo_full_name": "a/b", "file_path": "x.py"}, {"repo_full_name": "a/c", "extra": 1}]')
    df = L.read_landing(spark, p, array=True)
    assert [r["repo_full_name"] for r in df.orderBy("arrival").collect()] == ["a/b", "a/c"]


def test_json_lines_appended_to_an_array(spark):
    d = tmp() + "/land ing"
    os.mkdir(d)
    with open(d + "/metadata.json", "w") as f:
        f.write('\n[\n  {"repo_full_name": "a/b", "file_path": "x.py"},\n  {"repo_full_name": "a/c"}\n]\n')
    with open(d + "/one.json", "w") as f:
        f.write('[{"repo_full_name": "a/d"}, {"repo_full_name": "a/e"}]\n{"repo_full_name": "a/f"}\n{"cut\n')
    names = ["a/b", "a/c", "a/d", "a/e", "a/f"]
    assert sorted(r["repo_full_name"] for r in L.read_landing(spark, d).collect()) == names
    L.append_landing(spark.createDataFrame([(f"b/{i}", i) for i in range(20)], "repo_full_name string, seq long").coalesce(2), d)
    back = L.read_landing(spark, d)
    assert sorted(r["repo_full_name"] for r in back.collect()) == sorted(names + [f"b/{i}" for i in range(20)])
    assert back.drop("arrival").schema == L.SEQ_SCHEMA
    assert tuple(L.landing_rejects(spark, d).first()) == (26, 1, 0)
    first = [r["repo_full_name"] for r in back.filter("seq IS NULL").orderBy("arrival").collect()]
    assert first.index("a/b") < first.index("a/c") and first.index("a/d") < first.index("a/f")


def test_decode_content(spark):
    good = base64.b64encode("héllo\nworld".encode()).decode()
    wrapped = good[:4] + "\n" + good[4:]
    bad_utf8 = base64.b64encode(b"\xff\xfe").decode()
    df = spark.createDataFrame([(good,), (wrapped,), ("!!notbase64", ), (bad_utf8,), ("",)], "b string")
    got = [r[0] for r in df.select(decode_content("b")).collect()]
    assert got[:2] == ["héllo\nworld"] * 2 and got[2] is None and got[3] is None and got[4] == ""
    kept = L.decode_contents(df.withColumnRenamed("b", "content_b64"))
    assert kept.count() == 2


def test_lenient_text_and_file_names(spark):
    d = tmp()
    with open(os.path.join(d, "ok.py"), "wb") as f:
        f.write(b"x = 1\n\xff\n")
    with open(os.path.join(d, "__init__.py"), "wb") as f:
        f.write(b"# hidden\n")
    rows = L.read_text_files(spark, d).collect()
    assert [r["content"] for r in rows] == ["x = 1\n\n"]          # invalid byte dropped, _-files skipped


def test_path_helpers(spark):
    df = spark.createDataFrame([("scripts/tests/a.py", "o/r"), ("a.py", "o/r")], "p string, r string")
    rows = df.select(basename("p").alias("b"), dirname("p").alias("d"),
                     landing_path("collected_code", F.col("r"), F.col("p")).alias("l"),
                     preview(F.lit("x" * 1001), 1000).alias("pv")).collect()
    assert [(r["b"], r["d"]) for r in rows] == [("a.py", "scripts/tests"), ("a.py", "")]
    assert rows[0]["l"] == "collected_code/o_r/scripts/tests/a.py"
    assert rows[0]["pv"] == "x" * 1000 + "..."


def test_parse_repo_url(spark):
    urls = ["https://github.com/o/r", "https://github.com/o/r/", "github.com/o/r", "https://gitlab.com/o/r",
            "https://github.com/o", "https://github.com/o/r/tree/main"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [(r["v"]["is_valid"], r["v"]["owner"], r["v"]["repo"]) for r in df.select(parse_repo_url("u").alias("v")).collect()]
    assert got == [(True, "o", "r"), (True, "o", "r"), (False, None, None), (False, None, None),
                   (False, None, None), (True, "o", "r")]


def test_first_files_and_listing(spark):
    rows = [("o/r", n, p, None, None, 1) for n, p in
            [("z.py", "z.py"), ("a.py", "pkg/a.py"), ("b.md", "b.md"), ("c.py", "pkg/sub/c.py"), ("y.py", "y.py")]]
    listing = spark.createDataFrame(rows, "repo_full_name string, name string, path string, url string, sha string, size long")
    assert [r["path"] for r in RP.list_source_files(listing, 3).orderBy("rank").collect()] == ["y.py", "z.py", "pkg/a.py"]
    assert RP.list_source_files(listing, 0).count() == 0
    assert RP.list_source_files(listing, None).count() == 4


def test_select_and_lookup_repos(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    listing = spark.createDataFrame([("a", "o/a", "u", "d", 10, 1, t, t, "MIT License"),
                                     ("b", "o/b", "u", "d", 30, 5, t, t, None),
                                     ("c", "o/c", "u", "d", 30, 2, t, t, None)], REPO_LISTING_SCHEMA)
    sel = RP.select_repositories(listing, min_stars=5, max_results=2)
    assert [r["full_name"] for r in sel.collect()] == ["o/b", "o/c"]
    assert [r["full_name"] for r in RP.select_repositories(listing, sort="forks").collect()][0] == "o/b"
    with pytest.raises(ValueError):
        RP.select_repositories(listing, sort="size")
    req = spark.createDataFrame([("o/a",), ("x/missing",)], "full_name string")
    out = {r["full_name"]: r for r in RP.lookup_repositories(req, listing).collect()}
    assert out["x/missing"]["name"] == "missing" and out["x/missing"]["stars"] == 0
    assert out["x/missing"]["url"] == "https://github.com/x/missing" and out["o/a"]["found"]


def test_exports_and_snapshot(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "b", "c")], "id long, a string, b string")
    d = tmp()
    X.write_csv(df.coalesce(1), d + "/csv")
    text = "".join(open(os.path.join(d, "csv", f)).read() for f in sorted(os.listdir(d + "/csv")) if f.endswith(".csv"))
    assert text.splitlines()[0] == "id,a,b" and '1,,""' in text
    res = spark.createDataFrame([(1, "n", "o/r", 7.0, 3, True, ["a", "b"], "out/x")],
                                "id long, name string, repo_name string, quality_score double, code_lines long, "
                                "is_suitable boolean, tags array<string>, local_path string")
    p = X.export_report(res, d + "/exports", "csv")
    assert p.endswith(".csv") and "code_export_" in p
    with pytest.raises(ValueError):
        X.export_report(res, d + "/exports", "xml")
    root, counts = TB.snapshot(spark, {"files": df}, backup_dir=d + "/bk")
    assert {r["table"]: r["rows"] for r in counts.collect()} == {"files": 2}


def test_ast_pass_on_spark(spark):
    srcs = ["", 'class K:\n    def a(self):\n        return 1\n    def b(self, x):\n        if x:\n            return 1\n        return 2\n', 'def g(x):\n    while x:\n        x -= 1\n    return [i for i in range(3) if i]\n']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(srcs)], "i int, content string")
    out = with_complexity(analyze_ast(df, ["i"])).orderBy("i").collect()
    got = [(r["complexity"]["function_count"], r["complexity"]["avg_complexity"],
            r["complexity"]["max_complexity"]) for r in out]
    # K: methods 1 and 2 -> class int((1 + 3) / 2) + 1 = 3; g: 1 + while + comprehension(1 + if) = 4
    assert got == [(0, 0.0, 0), (3, 2.0, 3), (1, 4.0, 4)]
    assert [b["kind"] for b in out[1]["blocks"]] == ["class", "method", "method"]


def test_ast_rules():
    src = ("import os\nfrom x import *\n"
           "def f(a, b):\n    if a and b or a:\n        return [i for i in a if i]\n"
           "    for i in a:\n        pass\n    else:\n        pass\n"
           "    try:\n        pass\n    except:\n        pass\n    return 1 if a else 2\n"
           "class E:\n    pass\n"
           "def m(x):\n    match x:\n        case 1:\n            return 1\n        case _:\n            return 0\n")
    r = analyze_source(src)
    blocks = dict(zip(r["block_names"], r["block_complexities"]))
    assert blocks["f"] == 1 + 1 + 2 + 2 + 2 + 1 + 1   # if, boolop(3 values), comprehension+if, for+else, except, ifexp
    assert blocks["E"] == 1 and blocks["m"] == 2
    assert r["ast_warnings"] == 3                      # wildcard import, unused os, bare except
    bad = analyze_source("def (:")
    assert not bad["parse_ok"] and bad["ast_errors"] == 1 and bad["block_complexities"] == []


def test_score_with_ast_rules(spark):
    from quarry.operators.suitability import score_and_judge
    src = "import os\n\n\ndef f(x):\n    try:\n        return x\n    except:\n        return 0\n"
    df = spark.createDataFrame([(1, src, None), (2, "def (:\n", None), (3, None, None)],
                               "id int, content string, repo_license string")
    out = {r["id"]: r for r in score_and_judge(df, with_ast=True).collect()}
    r1 = out[1]
    # W: unused import + bare except; statements: import, def, try, return, return = 5
    assert r1["lint_findings"]["warning"] == 2 and r1["statements"] == 5
    assert r1["quality_score"] == round(10 - 10 * 2 / 5, 2) and r1["complexity"]["function_count"] == 1
    assert out[2]["lint_findings"]["error"] == 1 and out[2]["quality_score"] == 0.0
    assert out[3]["reason_code"] == "missing_file"


def test_nested_json_export(spark, tmp_path):
    from quarry.operators.catalog import import_landing
    from quarry.operators.report import nested_export
    from quarry.plans import bind as B
    from quarry.sources.exports import export_nested_json
    repos, files, _, _ = import_landing(B.b_landing(spark, "/root/testdata/sf0.001"))
    out = str(tmp_path / "nested")
    n = export_nested_json(nested_export(files, repos), out).first()["exported"]
    assert n == files.count()
    back = spark.read.json(out)
    assert "complexity" in back.columns and "avg_complexity" in back.schema["complexity"].dataType.fieldNames()


def test_ast_pass_holds_a_slice_and_hands_keys_through(spark):
    import pyarrow as pa

    from quarry.operators import complexity as C
    types = {"parse_ok": pa.bool_(), "statements": pa.int64()}
    rows = 2 * C.SLICE + 1
    batch = pa.RecordBatch.from_pydict({"k": [None, *range(1, rows)], "content": ["x = 1\n"] * rows})
    out = list(C.analyzed(iter([batch]), ["k"], "content", types))
    assert [b.num_rows for b in out] == [C.SLICE, C.SLICE, 1]
    assert [k for b in out for k in b.column(0).to_pylist()] == [None, *range(1, rows)]
    df = spark.createDataFrame([(None, (1, "a"), "def f(x):\n    return x\n"), (2, None, None)], "k bigint, s struct<a:int,b:string>, content string")
    got = analyze_ast(df, ["k", "s"])
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r["k"], r["s"], r["statements"], r["block_names"]) for r in got.collect()), key=str) == [
        (2, None, 0, []), (None, (1, "a"), 2, ["f"])]


def test_scan_visits_no_names_and_constants():
    import ast

    from quarry.operators import complexity as C
    src = "import a, b\ntype T = b\ndef f(p, *, q=1):\n    return [y for y in p if q and a] if p else {**q}\n"
    r = analyze_source(src)
    assert (r["statements"], r["ast_warnings"], r["block_complexities"]) == (4, 0, [5])
    assert ast.Name not in C._NODE_TYPES and ast.Constant not in C._NODE_TYPES and ast.Load not in C._NODE_TYPES
