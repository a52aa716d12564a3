"""Plan shape: partial aggregation before shuffles on hot keys, window group
limits, pushed-down filters, no cartesian products in registered queries."""

from pyspark.sql import functions as F

from conftest import SF001
from quarry.operators import catalog as C
from quarry.operators import repos as RP
from quarry.operators import tags as TG
from quarry.operators.ranking import rank_within_group


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=3000):
    # one key holds a third of all rows
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        F.col("id").alias("seq"), (F.col("id") * 7).alias("v"))


def test_first_wins_combines_map_side(spark):
    df = C.first_wins(hot(spark), ["k"])
    p = plan(df)
    assert "partial_min(" in p
    got = {r["k"]: r["v"] for r in df.collect()}
    assert got["hot"] == 0 and len(got) == 2001


def test_tag_fold_is_partial_hash_aggregate(spark):
    ops = hot(spark).select(F.lit(1).cast("bigint").alias("file_id"), F.col("k").alias("tag"),
                            F.when(F.col("seq") % 2 == 0, "add").otherwise("remove").alias("action"), "seq")
    p = plan(TG.fold_links(ops))
    assert "partial_max(" in p and "HashAggregate" in p


def test_per_repo_cap_uses_window_group_limit(spark):
    listing = hot(spark).select(F.col("k").alias("repo_full_name"), F.concat(F.col("seq").cast("string"), F.lit(".py")).alias("name"),
                                F.concat(F.lit("a/"), F.col("seq").cast("string"), F.lit(".py")).alias("path"))
    df = RP.list_source_files(listing, 5)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p
    assert df.filter(F.col("repo_full_name") == "hot").count() == 5


def test_large_cap_uses_range_rank(spark):
    listing = hot(spark, 3000).select(F.col("k").alias("repo_full_name"),
                                      F.concat(F.col("seq").cast("string"), F.lit(".py")).alias("name"),
                                      F.concat(F.lit("a/"), F.lpad(F.col("seq").cast("string"), 5, "0"), F.lit(".py")).alias("path"))
    small = RP.list_source_files(listing, 1000)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        big = RP.list_source_files(listing, 500)
        got = sorted((r["repo_full_name"], r["path"], r["rank"]) for r in big.collect())
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    want = sorted((r["repo_full_name"], r["path"], r["rank"]) for r in small.filter(F.col("rank") <= 500).collect())
    assert got == want and sum(1 for g in got if g[0] == "hot") == 500


def test_rank_splits_hot_group(spark):
    df = hot(spark, 3000)
    out = rank_within_group(df, "k", "seq", partitions=8)
    hot_rows = out.filter(F.col("k") == "hot").orderBy("seq").collect()
    assert [r["step"] for r in hot_rows] == list(range(1, 1001)) and hot_rows[0]["total"] == 1000
    other = out.filter(F.col("k") == "k1").collect()
    assert [(r["step"], r["total"]) for r in other] == [(1, 1)]


def test_filters_reach_parquet_scan(spark, tmp_path):
    from quarry.operators.search import search
    from quarry.plans.queries_catalog import catalog
    repos, files = catalog(spark, SF001)
    files.write.parquet(str(tmp_path / "files"))
    repos.write.parquet(str(tmp_path / "repos"))
    f = spark.read.parquet(str(tmp_path / "files"))
    r = spark.read.parquet(str(tmp_path / "repos"))
    p = plan(search(f, r, None, min_quality=6.0, suitable_only=True, limit=10, with_tags=False))
    assert "PushedFilters: [IsNotNull(quality_score), IsNotNull(is_suitable), GreaterThanOrEqual(quality_score,6.0)" in p \
        or ("GreaterThanOrEqual(quality_score,6.0)" in p and "EqualTo(is_suitable,true)" in p)
    assert "TakeOrderedAndProject" in p


EXECUTES_WHILE_BUILDING = {"a8_scan_catalogue", "j1_incremental_ingest", "j3_incremental_scoring",
                           "j2_job_status_stream", "k2_collect_repository", "j1_array_files", "j1_rejects", "j3_scores_once",
                           "h7_reimport_after_delete", "a6_text_store", "a6_texts_once",
                           "e12_dashboard_partials", "e4_top_repos_partials"}


def test_no_cartesian_products(spark):
    from quarry.plans.registry import load_all
    bad = []
    for name, q in load_all().items():
        if name in EXECUTES_WHILE_BUILDING:
            continue
        p = plan(q.build(spark, SF001))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(name)
    assert bad == []


def test_no_stored_table_is_read_as_an_rdd(spark):
    from quarry.plans.registry import load_all
    own = load_all()
    bad = [n for n, q in own.items() if n not in EXECUTES_WHILE_BUILDING and "ExistingRDD" in plan(q.build(spark, SF001))
           and n != "b16_parameters"]
    assert bad == []


def test_text_does_not_move_when_a_landing_is_judged(spark):
    """The texts are scored where they lie; no exchange carries them."""
    from quarry.operators.suitability import filter_landing
    from quarry.plans import bind as B
    p = filter_landing(B.b_landing(spark, SF001), B.b_modules(spark, SF001), B.PY_THRESHOLDS)
    p = p._jdf.queryExecution().optimizedPlan().toString()
    for line in p.splitlines():
        if "Aggregate" in line or "Join" in line:
            assert "content" not in line


def test_a_batch_scans_only_its_buckets(spark, tmp_path):
    from quarry.plans import bind as B
    from quarry.sources.tables import read_buckets, repo_bucket
    from quarry.streaming.ingest import ingest_batch
    root = str(tmp_path / "cat")
    landing = B.b_landing(spark, SF001)
    n_repos, n_files, *_ = ingest_batch(landing, root, buckets=8)
    assert n_repos > 1 and n_files > 100 and ingest_batch(landing, root)[:2] == (0, 0)
    one = landing.filter("repo_full_name = 'src1/en'").limit(1)
    touched = [r["b"] for r in one.select(repo_bucket("repo_full_name", 8).alias("b")).collect()]
    rows = read_buckets(spark, f"{root}/files", touched).select("path")
    import re
    assert len(touched) == 1 and re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {touched[0]}\)", plan(rows))


def test_search_takes_the_limit_before_repositories(spark):
    from quarry.operators.search import search
    from quarry.plans.queries_catalog import catalog, links
    repos, files = catalog(spark, SF001)
    free = plan(search(files, repos, links(spark, SF001), min_quality=1.0, limit=None))
    assert "Sort [quality_score" not in free and "PushedFilters: [IsNotNull(quality_score), GreaterThanOrEqual(quality_score" in free


def test_landing_scores_texts_where_they_lie(spark):
    """The signals are folded below the shuffle that brings files to their repository."""
    from quarry.plans import bind as B
    plan = B.b_landing_plan(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(repo_full_name")
    assert "aggregate(" in plan[exchange:] and "aggregate(" not in plan[:exchange]


def test_batches_look_texts_up_in_a_stored_table(spark):
    from quarry.plans import bind as B
    plan = B.b_module_store(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan and "local_path" in plan
