"""Text store, score cache, any landing in the stream, versioned deletes, key-driven fetch, two-level top-k."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import ranking as RK
from quarry.operators import repos as RP
from quarry.plans import curate
from quarry.schema import Thresholds
from quarry.sources import tables as T
from quarry.sources import texts as X
from quarry.sources.landing import read_landing, scan_landing
from quarry.streaming.ingest import Ingested, dead_letters, ingest_batch, run_ingest

ROW = {"repo_name": "a", "repo_full_name": "o/a", "repo_url": "u", "file_name": "f.py", "file_url": "u"}


def landing(spark, paths, **more):
    rows = [json.dumps({**ROW, "file_path": p, "local_path": f"/{p}", "seq": i, **more}) for i, p in enumerate(paths)]
    return spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", scan_landing(spark, "/none").drop("arrival", "_corrupt_record").schema).alias("r")).select("r.*")


def texts(spark, pairs):
    return spark.createDataFrame(pairs, "local_path string, content string")


def test_texts_are_stored_once(spark, tmp_path):
    root = str(tmp_path)
    assert X.stored_texts(spark, root) is None
    assert X.store_texts(texts(spark, [("/a", "x"), ("/b", "x"), ("/c", "y"), ("/d", None), (None, "z"), ("/a", "x"), ("/e", "")]), root, 1) == 3
    assert X.store_texts(texts(spark, [("/b", "y"), ("/f", "new")]), root, 2) == 1
    assert X.store_texts(texts(spark, [("/b", "y"), ("/f", "new")]), root, 2) == 0          # done again: nothing
    got = {r["local_path"]: r["content"] for r in X.stored_texts(spark, root).collect()}
    assert got == {"/a": "x", "/b": "y", "/c": "y", "/e": "", "/f": "new"}
    assert spark.read.parquet(f"{root}/texts").count() == 4
    some = X.stored_texts(spark, root, texts(spark, [("/b", ""), ("/none", "")]))
    assert [(r["local_path"], r["content"]) for r in some.collect()] == [("/b", "y")]
    assert X.store_texts(texts(spark, []), root, 3) == 0


def test_scores_are_kept_by_text_and_rules(spark, tmp_path):
    root = str(tmp_path)
    pairs = [("/a", "a = 1\n"), ("/b", "a = 1\n"), ("/c", "b = 2  \n"), ("/d", None)]
    first, n = X.cached_scores(texts(spark, pairs), root)
    assert n == 3                                                                           # two equal texts, one missing
    want = {r["local_path"]: (r["code_lines"], r["quality_score"]) for r in first.collect()}
    assert want["/a"] == want["/b"] and set(want) == {"/a", "/b", "/c", "/d"}
    again, n = X.cached_scores(texts(spark, [*pairs, ("/e", "b = 2  \n")]), root)
    assert n == 0 and {r["local_path"]: r["quality_score"] for r in again.collect()}["/e"] == want["/c"][1]
    from quarry.schema import LintRules
    _, n = X.cached_scores(texts(spark, pairs), root, Thresholds(lint=LintRules(max_line_length=3)))
    assert n == 3                                                                           # other rules, other scores


def test_only_new_files_are_scored(spark, tmp_path):
    root, th = str(tmp_path), Thresholds()
    contents = texts(spark, [(f"/{p}", f"{p} = 1\n" * 20) for p in "abcdef"])
    assert ingest_batch(landing(spark, "ab"), root, contents, th) == Ingested(1, 2, 2, 0)
    assert ingest_batch(landing(spark, "abc"), root, contents, th) == Ingested(0, 1, 1, 0)
    assert ingest_batch(landing(spark, "abc"), root, contents, th) == Ingested(0, 0, 0, 0)
    got = {r["path"]: (r["code_lines"], r["is_suitable"]) for r in spark.read.parquet(f"{root}/files").collect()}
    assert got == dict.fromkeys("abc", (20, True))


def test_stream_takes_arrays_lines_and_keeps_rejects(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "cat")
    land.mkdir()
    rec = lambda p, **more: {**ROW, "file_path": p, "local_path": f"/{p}", **more}
    (land / "lines.json").write_text("\n".join([json.dumps(rec("a")), '{"repo_name": "cut', "", json.dumps(rec("b", repo_full_name=None)), json.dumps(rec("c"))]))
    run_ingest(spark, str(land), root, fmt="json")
    (land / "an array.json").write_text("﻿" + json.dumps([rec("a", quality_score=1.0), rec("d"), rec("e", local_path=None)], indent=2))
    (land / "one line.json").write_text(json.dumps([rec("f"), rec("g")]))
    (land / "empty.json").write_text("")
    report = []
    run_ingest(spark, str(land), root, fmt="json", report=report)
    run_ingest(spark, str(land), root, fmt="json")                                          # nothing is left to do
    files = spark.read.parquet(f"{root}/files").collect()
    assert sorted(r["path"] for r in files) == list("acdfg") and not any(r["quality_score"] for r in files)
    assert [(r.files, r.rejects) for r in report] == [(3, 1)]
    bad = sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in dead_letters(spark, root).collect())
    assert bad == [("an%20array.json", "no local_path"), ("lines.json", "malformed record"), ("lines.json", "no repository")]
    assert read_landing(spark, str(land)).count() == 8


def test_rejected_batch_writes_nothing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="o/a"):
        ingest_batch(landing(spark, "ab", repo_url=None), root)
    assert not (tmp_path / "files").exists()


def test_import_after_delete(spark, tmp_path):
    root = str(tmp_path)
    ingest_batch(landing(spark, "ab", quality_score=1.0), root, version=1)
    ids = {r["path"]: r["id"] for r in spark.read.parquet(f"{root}/files").collect()}
    T.commit_deletes(spark.createDataFrame([(ids["a"],)], "id long"), root, 2)
    ops = spark.createDataFrame([(ids["a"], "old", "add", 1), (ids["a"], "new", "add", 4), (ids["b"], "old", "add", 1)],
                                "file_id long, tag string, action string, seq long")
    assert ingest_batch(landing(spark, "abc", quality_score=2.0), root, version=3).files == 2
    live = T.without_deleted(spark, root, spark.read.parquet(f"{root}/files"))
    assert sorted((r["path"], r["quality_score"]) for r in live.collect()) == [("a", 2.0), ("b", 1.0), ("c", 2.0)]
    assert sorted((r["file_id"], r["tag"]) for r in T.live_ops(spark, root, ops).collect()) == sorted([(ids["a"], "new"), (ids["b"], "old")])
    assert ingest_batch(landing(spark, "abc"), root, version=4).files == 0
    T.commit_deletes(spark.createDataFrame([(ids["a"],)], "id long"), root, 5)
    assert T.without_deleted(spark, root, spark.read.parquet(f"{root}/files")).count() == 2


def _exchanged(df):
    """Relations below an exchange of the plan as first made (no size is known to it)."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_fetched_by_key(spark, tmp_path):
    n = 4000
    bodies = spark.range(n).select(F.concat(F.lit("o/"), (F.col("id") % 100).cast("string")).alias("repo_full_name"),
                                   F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
                                   F.base64(F.encode(F.repeat(F.lit("a = 1\n"), 20), "UTF-8")).alias("content_b64"))
    bodies.write.parquet(str(tmp_path / "bodies"))
    stored = spark.read.parquet(str(tmp_path / "bodies"))
    files = spark.createDataFrame([("o/3", "f", p, "u", 0) for p in ("p3", "p103", "gone")], "repo_full_name string, name string, path string, url string, seq int")
    got = curate.fetch_bodies(files, stored, ["o/3"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "In(repo_full_name" in scan or "EqualTo(repo_full_name,o/3)" in scan, plan        # the filter reaches the scan
    rows = {r["file_path"]: r["content_b64"] for r in got.collect()}
    assert set(rows) == {"p3", "p103", "gone"} and rows["gone"] is None and rows["p3"]
    # without names the few keys are sent to the bodies, which stay where they are
    free = curate.fetch_bodies(files, stored)
    final = free._jdf.queryExecution()
    assert free.count() == 3 and "BroadcastHashJoin" in final.executedPlan().toString()


def test_files_that_cannot_be_analysed_are_rows(spark):
    import base64
    enc = lambda s: base64.b64encode(s.encode()).decode()
    repos = spark.createDataFrame([("a", "o/a", "u", 1, None)], "name string, full_name string, url string, stars long, license string")
    files = spark.createDataFrame([("o/a", p, p, "u", 0) for p in ("ok", "deep", "bad", "none")], "repo_full_name string, name string, path string, url string, seq int")
    bodies = spark.createDataFrame([("o/a", "ok", enc("a = 1\n" * 20)), ("o/a", "deep", enc("x = " + "-" * 20000 + "1\n")), ("o/a", "bad", enc("def (\n" * 20))],
                                   "repo_full_name string, path string, content_b64 string")
    got = {r["file_path"]: r for r in curate.land_files(repos, files, bodies, Thresholds(), "d", F.localtimestamp()).collect()}
    assert set(got) == {"ok", "deep", "bad"} and got["ok"]["is_suitable"]
    deep = got["deep"]
    assert deep["quality_score"] is None and deep["is_suitable"] is None and deep["code_lines"] == 0 and "MemoryError" in deep["unsuitable_reason"]
    assert got["bad"]["is_suitable"] is not None                                            # a syntax error is a finding, not a failure


@pytest.mark.parametrize("k", [1, 7, 1500])
def test_two_level_top_k(spark, k):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, "hot").when(F.col("id") < 5000, F.lit(None)).otherwise("b").alias("repo_full_name"),
                                    F.concat(F.lit("d/" * 1), (F.col("id") % 1700).cast("string")).alias("path"))
    from pyspark.sql import Window
    w = Window.partitionBy("repo_full_name").orderBy("depth", "path")
    got = RP.first_files_per_repo(rows, k)
    plain = rows.withColumn("depth", F.lit(1).cast("bigint")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    key = lambda r: (r["repo_full_name"] or "", r["rank"], r["path"])
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert RK.top_per_group(rows.limit(0), ["repo_full_name"], [F.col("path")], k).count() == 0


def test_cli_crawl_view_replace_filter(spark, tmp_path, capsys):
    from conftest import SF001

    from quarry import cli
    from quarry.plans import bind as B
    paths = {}
    for name, df in (("repos", B.b_repos(spark, SF001)), ("files", B.b_listing(spark, SF001)), ("bodies", B.b_file_bodies(spark, SF001))):
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    land, cat = str(tmp_path / "landing"), str(tmp_path / "cat")
    common = [x for n, p in paths.items() for x in (f"--{n}", p)]
    cli.main(["crawl", *common, "--out", land, "--catalog", cat, "--max-repos", "2", "--max-files", "3"], spark)
    out = capsys.readouterr().out
    assert "stored: 6 texts" in out and "imported: 2 repositories, 6 files" in out
    cli.main(["crawl", *common, "--out", land, "--catalog", cat, "--max-repos", "2", "--max-files", "3"], spark)
    out = capsys.readouterr().out
    assert "stored: 0 texts" in out and "imported: 0 repositories, 0 files" in out
    one = spark.read.parquet(f"{cat}/files").orderBy("id").first()
    cli.main(["view", "--catalog", cat, f"--id={one['id']}", "--full"], spark)
    assert "class Doc" in capsys.readouterr().out
    judged = str(tmp_path / "judged")
    cli.main(["filter", "--landing", land, "--out", judged, "--catalog", cat], spark)
    assert "scored: 6 texts" in capsys.readouterr().out
    cli.main(["replace", "--catalog", cat, f"--id={one['id']}", "--text", "a = 1\n" * 30], spark)
    cli.main(["replace", "--catalog", cat, "--id=17", "--text", ""], spark)
    cli.main(["view", "--catalog", cat, f"--id={one['id']}"], spark)
    out = capsys.readouterr().out
    assert f"{one['id']}: updated" in out and "17: not_found" in out and "a = 1" in out and "class Doc" not in out
    cli.main(["filter", "--landing", land, "--out", judged, "--catalog", cat], spark)
    assert "scored: 1 texts" in capsys.readouterr().out
    # deleted, then imported again
    cli.main(["tag", "--catalog", cat, f"--ids={one['id']}", "--tag", "keep"], spark)
    cli.main(["delete", "--catalog", cat, f"--ids={one['id']}"], spark)
    cli.main(["import", "--landing", land, "--catalog", cat], spark)
    assert "imported: 0 repositories, 1 files" in capsys.readouterr().out
    cli.main(["tags", "--catalog", cat], spark)
    assert "keep" not in capsys.readouterr().out


def test_partial_sums_equal_the_full_scan(spark, tmp_path):
    from quarry.operators.stats import dashboard, license_distribution
    from quarry.sources import partials as P
    root = str(tmp_path)
    links = spark.createDataFrame([], "file_id long, tag string")

    def check():
        repos, files = spark.read.parquet(f"{root}/repositories"), T.without_deleted(spark, root, spark.read.parquet(f"{root}/files"))
        want, got = dashboard(spark, repos, files, links)["scalars"].first().asDict(), P.scalars(spark, root)
        assert {k: v for k, v in got.first().asDict().items() if k in want} == want
        assert sorted(map(tuple, P.licences(spark, root).collect())) == sorted(map(tuple, license_distribution(repos).collect()))
        counts = {r["repo_full_name"]: r["count"] for r in files.groupBy("repo_full_name").count().collect()}
        assert {r["full_name"]: r["file_count"] for r in P.top_repositories(spark, root).collect()} == counts
        assert not [f for f in got.inputFiles() if "/files/" in f]
    for v, (names, more) in enumerate([("abc", {"quality_score": 7.5, "code_lines": 10, "is_suitable": True}), ("bcd", {"quality_score": 1.25}),
                                       ("ef", {"repo_full_name": "o/b", "repo_license": "MIT License"})]):
        ingest_batch(landing(spark, names, **more), root, version=10 * v + 1)
        if v != 1:                                                      # one refresh may take several batches
            P.refresh(spark, root)
            check()
    ids = {r["path"]: r["id"] for r in spark.read.parquet(f"{root}/files").collect()}
    gone = lambda names, v: T.commit_deletes(spark.createDataFrame([(ids[n],) for n in names], "id long"), root, v)
    gone("ab", 30), gone("a", 31), gone("ef", 32)
    P.refresh(spark, root)
    check()
    ingest_batch(landing(spark, "a", quality_score=3.0), root, version=40)
    gone("a", 41)
    ingest_batch(landing(spark, "a", quality_score=4.0), root, version=42)
    assert P.refresh(spark, root) == 42 and P.refresh(spark, root) == 42    # nothing new: nothing changes
    check()


def test_search_by_postings_equals_the_scan(spark, tmp_path):
    from conftest import SF001

    from quarry.operators import postings as G
    from quarry.operators.search import search
    from quarry.plans.queries_catalog import catalog
    repos, files = catalog(spark, SF001)
    root = str(tmp_path)
    assert G.search_postings(spark, root, files, repos, query="src1", with_tags=False).count() > 0       # no postings yet
    G.append_postings(files, repos, root)
    G.append_postings(files.limit(5), repos.limit(1), root)                                              # a batch done again
    for q in ("src1", "DOC_1", "%", "_", "c", "0.py", "src1/en", "en/doc%7", "zzz", "\\", "É1x", None):
        key = lambda df: sorted((r["id"], r["repo_name"]) for r in df.collect())
        got = G.search_postings(spark, root, files, repos, query=q, limit=None, with_tags=False)
        assert key(got) == key(search(files, repos, query=q, limit=None, with_tags=False)), q
    few = G.candidates(spark, root, files, "doc_17.py")
    assert 0 < few.count() < files.count() / 4
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan
