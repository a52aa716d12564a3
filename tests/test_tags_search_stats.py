"""H3-H6 tag fold, D2/D3, G1 search (B7-B9), E1-E6, E9 statistics."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from quarry.operators import search as S
from quarry.operators import stats as ST
from quarry.operators import tags as TG
from quarry.schema import TAG_OPS_SCHEMA


def ops(spark, rows):
    return spark.createDataFrame(rows, TAG_OPS_SCHEMA)


def test_tag_fold_cases(spark):
    log = ops(spark, [(1, "a", "add", 1), (1, "a", "add", 2),            # add twice
                      (1, "b", "remove", 3),                            # remove unknown
                      (2, "a", "add", 4), (2, "a", "remove", 5), (2, "a", "add", 6),  # add-remove-add
                      (3, "c", "add", 7), (3, "c", "remove", 8),
                      (99, "z", "add", 9)])                             # tag on unknown file
    links = {(r["file_id"], r["tag"]) for r in TG.fold_links(log).collect()}
    assert links == {(1, "a"), (2, "a"), (99, "z")}
    names = {r["name"] for r in TG.tag_table(log).collect()}
    assert names == {"a", "c", "z"}                                     # never garbage-collected; 'b' never added
    with pytest.raises(ValueError):
        TG.validate_action("rename")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("xyz"), st.sampled_from(["add", "remove"])),
                max_size=25))
def test_fold_equals_sequential_set(spark, seq_ops):
    state = set()
    for f, t, a in seq_ops:
        (state.add if a == "add" else state.discard)((f, t))
    rows = [(f, t, a, i) for i, (f, t, a) in enumerate(seq_ops)]
    random.shuffle(rows)
    got = {(r["file_id"], r["tag"]) for r in TG.fold_links(ops(spark, rows)).collect()} if rows else set()
    assert got == state


def test_batch_status(spark):
    log = ops(spark, [(1, "q", "add", 1)])
    batch = TG.batch_ops(spark.createDataFrame([(1,), (2,)], "id long"), "q", "add", 100)
    st_ = {r["file_id"]: (r["success"], r["changed"]) for r in TG.batch_status(log, batch).collect()}
    assert st_ == {1: (True, False), 2: (True, True)}


@pytest.fixture(scope="module")
def cat(spark):
    repos = spark.createDataFrame([(10, "r1", "o/r1", "u1", 5, "MIT License"), (20, "R_2", "o/R_2", "u2", 1, None),
                                   (30, "empty", "o/empty", "u3", 0, "")],
                                  "id long, name string, full_name string, url string, stars long, license string")
    files = spark.createDataFrame([
        (1, 10, "o/r1", "a.py", "src/a.py", "out/a", 7.5, 20, True),
        (2, 10, "o/r1", "b%.py", "src/b%.py", "out/b", None, 5, False),
        (3, 20, "o/R_2", "C.PY", "x\\y.py", "out/c", 0.0, 0, False),
        (4, 20, "o/R_2", "d.py", "d.py", "out/d", 7.5, 30, True),
        (5, 20, "o/R_2", "e.py", "e.py", "out/e", 2.0, 12, False)],
        "id long, repo_id long, repo_full_name string, name string, path string, local_path string, "
        "quality_score double, code_lines long, is_suitable boolean")
    links = spark.createDataFrame([(1, "x"), (1, "y"), (4, "y"), (9, "x")], "file_id long, tag string")
    return repos, files, links


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_filters(cat):
    repos, files, links = cat
    assert ids(S.search(files, repos, links)) == [1, 4, 5, 3, 2]             # score desc, nulls last, id ties
    assert ids(S.search(files, repos, links, query="")) == [1, 4, 5, 3, 2]   # empty query = no predicate
    assert ids(S.search(files, repos, links, query="%")) == [1, 4, 5, 3, 2]  # % stays a wildcard
    assert ids(S.search(files, repos, links, query="b%")) == [2]
    assert ids(S.search(files, repos, links, query="r_2")) == [4, 5, 3]      # case-insensitive, _ wildcard
    assert ids(S.search(files, repos, links, query="x\\y")) == [3]           # backslash is literal
    assert ids(S.search(files, repos, links, min_quality=None)) == [1, 4, 5, 3, 2]
    assert ids(S.search(files, repos, links, min_quality=0)) == [1, 4, 5, 3]  # 0 drops null scores
    assert ids(S.search(files, repos, links, min_quality="")) == [1, 4, 5, 3, 2]  # blank = None
    assert ids(S.search(files, repos, links, suitable_only=True)) == [1, 4]
    assert ids(S.search(files, repos, links, tags=["y"])) == [1, 4]
    assert ids(S.search(files, repos, links, limit=0)) == []
    assert sorted(ids(S.search(files, repos, links, limit=-1))) == [1, 2, 3, 4, 5]    # no limit, no order
    assert ids(S.search(files, repos, links, limit=2)) == [1, 4]
    top = S.search(files, repos, links, limit=1).first()
    assert top["tags"] == ["x", "y"] and top["repo_name"] == "o/r1"


def test_stats(spark, cat):
    repos, files, links = cat
    tags = spark.createDataFrame([(1, "x"), (2, "y"), (3, "never_used")], "id long, name string")
    c = ST.table_counts(repos, files, tags).first()
    assert (c["repository_count"], c["file_count"], c["suitable_file_count"], c["tag_count"]) == (3, 5, 2, 3)
    a = ST.score_and_lines(files).first()
    assert a["average_quality_score"] == round((7.5 + 0 + 7.5 + 2.0) / 4, 2)
    assert a["average_code_lines"] == round(67 / 5, 2)
    lic = {r["license"]: r["count"] for r in ST.license_distribution(repos).collect()}
    assert lic == {"MIT License": 1, "Unknown": 2}                           # null and '' merged
    top = ST.top_repositories(files, repos).collect()
    assert [(r["name"], r["file_count"]) for r in top] == [("R_2", 3), ("r1", 2)]   # repo without files drops
    tt = TG.top_tags(links).collect()
    assert [(r["name"], r["count"]) for r in tt] == [("x", 2), ("y", 2)]       # orphan link counts
    s = ST.statistics(repos, files, tags).first()
    assert s["license_distribution"] == {"MIT License": 1, "Unknown": 2}


def test_histogram_edges(spark):
    vals = [-1.0, 0.0, 1.999, 2.0, 8.0, 10.0, 11.0, None]
    f = spark.createDataFrame([(v,) for v in vals], "quality_score double")
    h = {r["bin"]: r["count"] for r in ST.score_histogram(spark, f).collect()}
    assert h == {0: 3, 1: 1, 2: 0, 3: 0, 4: 3}
    empty = spark.createDataFrame([], "quality_score double")
    assert {r["bin"]: r["count"] for r in ST.score_histogram(spark, empty).collect()} == {i: 0 for i in range(5)}


def test_flat_stats_null_group(spark):
    flat = spark.createDataFrame([("a", 7.0), ("a", 5.0), (None, 6.0), (None, None)], "repo_name string, quality_score double")
    r = ST.flat_stats(flat).first()
    assert (r["total_repos"], r["total_files"], r["suitable_files"]) == (2, 4, 2)
    assert r["avg_quality"] == 6.0


def test_limit_column_stays_in_spark(spark, monkeypatch):
    from conftest import SF001

    from quarry.plans import queries_changes as QC
    texts = ["", " \t", "-1", "0", " 7 ", "9000000000", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["limit"] for r in df.select(S.limit_column(df["text"]).alias("limit")).collect()]
    assert got == [S.normalize_limit(t) for t in texts]

    def collect(self):
        raise AssertionError("rows collected while the query is built")
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", collect)
        q = QC.b16_parameters(spark, SF001)
    assert q.dtypes == [("text", "string"), ("limit", "bigint")] and q.count() > 0
