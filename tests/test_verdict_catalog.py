"""B3-B6 verdict, H1/H2 import (first wins, rejects), D8/E10, H7-H9."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import catalog as C
from quarry.operators.suitability import apply_verdict, score_and_judge, suitable, unsuitable, verdict_counts
from quarry.schema import COMPLEXITY_TYPE, Thresholds
from quarry.sources.landing import SEQ_SCHEMA


def judge(spark, rows, th=Thresholds()):
    df = spark.createDataFrame(rows, "i int, content string, repo_license string, code_lines long, "
                                     "quality_score_raw double")
    out = apply_verdict(df, th).orderBy("i").collect()
    return [(r["reason_code"], r["is_suitable"], r["unsuitable_reason"]) for r in out]


def test_verdict_bounds_and_order(spark):
    rows = [(0, "x", "MIT License", 9, 9.0), (1, "x", "MIT License", 10, 6.0), (2, "x", None, 1000, 7.0),
            (3, "x", None, 1001, 7.0), (4, "x", None, 50, 5.99), (5, None, "GPL", 0, 0.0),
            (6, "x", "GPL", 5, 1.0), (7, "x", None, 50, None), (8, "x", "", 50, 9.0)]
    got = judge(spark, rows)
    assert got[0] == ("too_few_lines", False, "코드 라인 수 부족 (9 < 10)")
    assert got[1] == ("ok", True, None)
    assert got[2] == ("ok", True, None)
    assert got[3] == ("too_many_lines", False, "코드 라인 수 초과 (1001 > 1000)")
    assert got[4] == ("low_quality", False, "품질 점수 미달 (6.0 < 6.0)")   # 5.99 prints as 6.0, as in Python
    assert got[5] == ("missing_file", False, "파일이 존재하지 않음")
    assert got[6] == ("license", False, "라이센스 호환성 문제 (GPL)")        # licence before size and score
    assert got[7] == ("low_quality", False, "품질 점수 미달 (0.0 < 6.0)")    # null score counts as 0.0
    assert got[8] == ("license", False, "라이센스 호환성 문제 ()")


def test_score_and_judge_counts(spark):
    texts = ["\n".join(f"v{i} = {i}" for i in range(12)) + "\n", "# only comment\n", None]
    df = spark.createDataFrame([(t, None) for t in texts], "content string, repo_license string")
    judged = score_and_judge(df)
    c = verdict_counts(judged).first()
    assert (c["suitable"], c["unsuitable"]) == (1, 2)
    assert suitable(judged).count() + unsuitable(judged).count() == 3
    assert judged.filter(F.col("content").isNull()).first()["code_lines"] == 0


def landing(spark, rows):
    full = []
    for r in rows:
        d = {f.name: None for f in SEQ_SCHEMA.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in SEQ_SCHEMA.fields))
    return spark.createDataFrame(full, SEQ_SCHEMA)


def base_row(seq, repo="o/r", path="a.py", score=7.0, **kw):
    r = {"repo_name": repo.split("/")[-1] if repo else None, "repo_full_name": repo, "repo_url": f"https://x/{repo}",
         "repo_stars": 5, "repo_license": "MIT License", "file_name": path.split("/")[-1], "file_path": path,
         "file_url": f"https://x/{repo}/{path}", "local_path": f"out/{path}", "quality_score": score,
         "downloaded_at": "2025-03-28T09:18:47.765961", "code_lines": 20, "is_suitable": True,
         "complexity": {"avg_complexity": 1.5, "function_count": 2, "max_complexity": 2}, "seq": seq}
    r.update(kw)
    return r


def test_import_first_wins_and_rejects(spark):
    rows = [base_row(1, score=7.0), base_row(2, score=1.0),                 # duplicate key in one batch
            base_row(3, path="b.py", local_path=None),                      # NOT NULL local_path -> rejected
            base_row(4, repo=None, path="c.py"),                             # no repository key -> skipped
            base_row(5, repo="", path="d.py"),
            base_row(6, path="e.py", complexity=None, repo_stars=None),    # null complexity -> null columns
            base_row(7, repo="o/s", path="a.py", is_suitable=None)]
    repos, files, new_r, new_f = C.import_landing(landing(spark, rows))
    f = {(r["repo_full_name"], r["path"]): r for r in files.collect()}
    assert set(f) == {("o/r", "a.py"), ("o/r", "e.py"), ("o/s", "a.py")}
    assert f[("o/r", "a.py")]["quality_score"] == 7.0
    assert f[("o/r", "e.py")]["complexity_avg"] is None
    assert f[("o/s", "a.py")]["is_suitable"] is False
    assert f[("o/r", "a.py")]["downloaded_at"] == dt.datetime(2025, 3, 28, 9, 18, 47, 765961)
    assert sorted(r["full_name"] for r in repos.collect()) == ["o/r", "o/s"]
    assert {r["full_name"]: r["stars"] for r in repos.collect()}["o/r"] == 5


def test_import_is_idempotent_and_counts_new(spark):
    first = landing(spark, [base_row(1), base_row(2, path="b.py")])
    r1, f1, _, _ = C.import_landing(first)
    second = landing(spark, [base_row(10, score=0.5), base_row(11, path="z.py"), base_row(12, repo="n/n")])
    r2, f2, new_r, new_f = C.import_landing(second, r1, f1)
    counts = C.import_counts(new_r, new_f).first()
    assert (counts["new_repositories"], counts["new_files"]) == (1, 2)
    assert {r["quality_score"] for r in f2.filter(F.col("path") == "a.py").collect()} == {7.0}
    r3, f3, new_r3, new_f3 = C.import_landing(second, r2, f2)
    assert new_r3.count() == 0 and new_f3.count() == 0 and f3.count() == f2.count()


def test_invalid_repo_rows(spark):
    import pytest
    bad = landing(spark, [base_row(1, repo_url=None), base_row(2, repo="p/q", path="x.py")])
    assert [r["full_name"] for r in C.invalid_repo_rows(bad).collect()] == ["o/r"]
    with pytest.raises(ValueError):
        C.assert_importable(bad)
    C.assert_importable(landing(spark, [base_row(1), base_row(2, repo_url=None)]))   # only the first row counts


def test_delete_and_replace(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    tags = spark.createDataFrame([(1, "t"), (2, "t"), (9, "t")], "file_id long, tag string")
    contents = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, content string")
    out = C.delete_files(spark.createDataFrame([(2,), (7,)], "id long"), files, tags, contents)
    assert sorted(r["id"] for r in out["files"].collect()) == [1, 3]
    assert sorted(r["file_id"] for r in out["file_tags"].collect()) == [1, 9]     # orphan link stays
    assert {r["id"]: r["status"] for r in out["status"].collect()} == {2: "deleted", 7: "not_found"}
    assert sorted(r["id"] for r in out["contents"].collect()) == [1, 3]
    upd = spark.createDataFrame([(1, "new1", 1), (1, "new2", 2), (5, "ghost", 1)], "id long, content string, seq long")
    merged = {r["id"]: (r["content"], r["changed"]) for r in C.replace_contents(contents, upd).collect()}
    assert merged == {1: ("new2", True), 2: ("y", False), 3: ("z", False)}
    assert {r["id"]: r["status"] for r in C.update_status(contents, upd).collect()} == {1: "updated", 5: "not_found"}


def test_complexity_struct_type():
    assert [f.name for f in COMPLEXITY_TYPE.fields] == ["avg_complexity", "function_count", "max_complexity"]
