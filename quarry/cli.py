"""Command line (K4): thin spark-submit entry over a Parquet catalogue root.

    spark-submit -m quarry.cli <command> --catalog ROOT ...

Catalogue layout under ROOT: repositories/, files/, tag_ops/ (append-only
tag log), tombstones/, texts/ + text_paths/ + scores/ (`sources.texts`), dead_letters/ and, where
a user brings one, contents/ (id, content). Every command is a few Spark jobs built from
the operators; results are shown with `show()` (bounded) or written out.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.schema import CLI_SEARCH_LIMIT, TAG_OPS_SCHEMA, Thresholds


def _thresholds(a) -> Thresholds:
    return Thresholds(min_quality=a.min_quality, min_lines=a.min_lines, max_lines=a.max_lines)


def _read(spark, root, name, schema=None):
    from quarry.sources.landing import path_exists
    from quarry.sources.tables import without_deleted
    path = f"{root}/{name}"
    if path_exists(spark, path):
        df = spark.read.parquet(path).drop("bucket")
        return without_deleted(spark, root, df).drop("version") if name == "files" else df
    return spark.createDataFrame([], schema) if schema is not None else None


def _import(spark, path, a):
    """H1/H2 + E10: append the new rows of a landing; their numbers are observed while
    writing. Records that cannot be imported go to the catalogue's dead letters."""
    from quarry.sources.landing import scan_landing
    from quarry.streaming.ingest import ingest_batch
    done = ingest_batch(scan_landing(spark, path, a.format), a.catalog)
    if done.rejects:
        print(f"{done.rejects} records left out")
    print(f"imported: {done.repositories} repositories, {done.files} files")


def cmd_filter(spark, a):
    """Judge a landing by texts given with --contents or stored in the catalogue; with a
    catalogue a text is scored once, however many landings name it."""
    from quarry.operators.suitability import filter_landing, judge_landing, verdict_counts, wanted_texts
    from quarry.sources.landing import landing_rejects, read_landing, write_landing
    from quarry.sources.texts import cached_scores, stored_texts
    if not (a.contents or a.catalog):
        raise SystemExit("filter needs --contents or --catalog")
    bad = landing_rejects(spark, a.landing, a.format).first()["rejects"]
    if bad:
        print(f"{bad} malformed records left out")
    landing, th = read_landing(spark, a.landing, a.format), _thresholds(a)
    texts = spark.read.parquet(a.contents) if a.contents else stored_texts(spark, a.catalog, landing)
    if texts is None:
        raise SystemExit(f"no texts are stored in {a.catalog}")
    if a.catalog:
        signals, scored = cached_scores(wanted_texts(landing, texts), a.catalog, th)
        print(f"scored: {scored} texts")
        judged = judge_landing(landing, signals, th)
    else:
        judged = filter_landing(landing, texts, th)
    write_landing(judged, a.out, a.format)
    verdict_counts(read_landing(spark, a.out, a.format)).show()
    if a.catalog:
        _import(spark, a.out, a)


def cmd_import(spark, a):
    _import(spark, a.landing, a)


def cmd_crawl(spark, a):
    """K1 / K2 over tables: collect, judge and land; with --catalog also import, and store the texts."""
    from quarry.operators.suitability import verdict_counts
    from quarry.plans.curate import collect_by_query, collect_repository, land_and_store
    from quarry.sources.landing import read_landing
    repos, files, bodies = (spark.read.parquet(p) for p in (a.repos, a.files, a.bodies))
    cap = a.max_files if a.max_files and a.max_files > 0 else None      # blank or none: no cap (B16)
    if a.url:
        landed = collect_repository(spark, a.url, repos, files, bodies, _thresholds(a), cap, out_dir=a.out_dir)
    else:
        landed = collect_by_query(repos, files, bodies, _thresholds(a), a.max_repos, cap, out_dir=a.out_dir,
                                  min_stars=a.min_stars, license=a.license, sort=a.sort)
    new = land_and_store(landed, a.out, a.catalog, a.format)
    verdict_counts(read_landing(spark, a.out, a.format)).show()
    if a.catalog:
        print(f"stored: {new} texts")
        _import(spark, a.out, a)


def _texts(spark, a, ids):
    """(id, content) of the files `ids` from the catalogue's text store, else from its contents table; None without either."""
    from quarry.sources.landing import path_exists
    from quarry.sources.tables import current_contents
    from quarry.sources.texts import stored_texts
    paths = _read(spark, a.catalog, "files").join(ids, "id", "left_semi").select("id", "local_path")
    found = stored_texts(spark, a.catalog, paths)
    if found is not None:
        return paths.join(found, "local_path").select("id", "content")
    return current_contents(spark, a.catalog) if path_exists(spark, f"{a.catalog}/contents") else None


def cmd_replace(spark, a):
    """H9: put another text in the place of one file's; its score stays until the next filter."""
    from quarry.sources.texts import store_texts
    ids = spark.createDataFrame([(a.id,)], "id long")
    text = open(a.file, encoding="utf-8").read() if a.file else a.text
    rows = _read(spark, a.catalog, "files").join(ids, "id", "left_semi").select("local_path", F.lit(text).alias("content"))
    if rows.isEmpty():
        print(f"{a.id}: not_found")
        return
    store_texts(rows, a.catalog, time.time_ns())
    print(f"{a.id}: updated")


def cmd_view(spark, a):
    """One file's record and its text or a preview."""
    from quarry.operators.search import lookup
    ids = spark.createDataFrame([(a.id,)], "id long")
    rows = lookup(_read(spark, a.catalog, "files"), ids, _texts(spark, a, ids), None if a.full else 1000).collect()
    if not rows:
        print(f"no file {a.id}")
    for name, value in (rows[0].asDict().items() if rows else ()):
        print(f"{name}: {value}")


def cmd_tags(spark, a):
    from quarry.operators.tags import tag_counts
    tag_counts(_links(spark, a)).orderBy(F.desc("count"), "name").show(a.limit, truncate=False)


def cmd_delete(spark, a):
    """H7/H8: tombstones for ids; prints each id's status."""
    from quarry.operators.catalog import delete_files
    from quarry.sources.tables import commit_deletes
    ids = spark.createDataFrame([(int(i),) for i in a.ids.split(",")], "id long")
    status = delete_files(ids, _read(spark, a.catalog, "files"), _links(spark, a))["status"].collect()
    hit = [(r["id"],) for r in status if r["status"] == "deleted"]
    if hit:
        commit_deletes(spark.createDataFrame(hit, "id long"), a.catalog, time.time_ns())
    for r in status:
        print(f"{r['id']}: {r['status']}")


def _links(spark, a):
    from quarry.operators.tags import fold_links
    from quarry.sources.tables import live_ops
    return fold_links(live_ops(spark, a.catalog, _read(spark, a.catalog, "tag_ops", TAG_OPS_SCHEMA)))


def cmd_search(spark, a):
    from quarry.operators.report import display_rows
    from quarry.operators.search import search
    res = search(_read(spark, a.catalog, "files"), _read(spark, a.catalog, "repositories"), _links(spark, a),
                 query=a.query, tags=a.tags.split(",") if a.tags else None, min_quality=a.min_quality,
                 suitable_only=a.suitable_only, limit=a.limit)
    rows = display_rows(res)
    if a.limit is not None and a.limit < 0:              # no limit: all rows, a partition at a time
        for r in rows.toLocalIterator():
            print(" | ".join(str(v) for v in r))
    else:
        rows.show(a.limit, truncate=False)


def cmd_tag(spark, a):
    from quarry.operators.tags import batch_ops
    ids = spark.createDataFrame([(int(i),) for i in a.ids.split(",")], "id long")
    ops = batch_ops(ids, a.tag, a.action, seq_base=time.time_ns())
    ops.write.mode("append").parquet(f"{a.catalog}/tag_ops")


def cmd_stats(spark, a):
    from quarry.operators.stats import statistics
    from quarry.operators.tags import tag_table
    statistics(_read(spark, a.catalog, "repositories"), _read(spark, a.catalog, "files"),
               tag_table(_read(spark, a.catalog, "tag_ops", TAG_OPS_SCHEMA))).show(truncate=False)


def cmd_export(spark, a):
    from quarry.operators.report import flat_export, nested_export
    from quarry.sources.exports import write_csv, write_json
    files, repos = _read(spark, a.catalog, "files"), _read(spark, a.catalog, "repositories")
    if a.format == "csv":
        write_csv(flat_export(files, repos), a.out)
    else:
        write_json(nested_export(files, repos).drop("file_id"), a.out)
    print(a.out)


def cmd_backup(spark, a):
    from quarry.sources.tables import snapshot
    tables = {n: df for n in ("repositories", "files", "tag_ops", "contents", "content_versions", "tombstones", "landing", "texts", "text_paths", "scores", "dead_letters")
              if (df := _read(spark, a.catalog, n)) is not None}
    if a.landing:
        from quarry.sources.landing import read_landing
        tables["landing"] = read_landing(spark, a.landing, a.format).drop("arrival")
    root, counts = snapshot(spark, tables, a.out)
    print(root)
    counts.show()


def cmd_sync(spark, a):
    cmd_import(spark, a)
    from quarry.operators.report import nested_export
    from quarry.sources.landing import write_landing
    exported = nested_export(_read(spark, a.catalog, "files"), _read(spark, a.catalog, "repositories"))
    write_landing(exported.withColumn("seq", F.col("file_id")), a.out, a.format)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, fn, *args):
        s = sub.add_parser(name)
        s.set_defaults(fn=fn)
        for a in args:
            a(s)
        return s

    cat = lambda s: s.add_argument("--catalog", required=True)
    land = lambda s: (s.add_argument("--landing", required=True),
                      s.add_argument("--format", default="json", choices=["json", "parquet"]))

    def th(s):
        s.add_argument("--min-quality", type=float, default=6.0)
        s.add_argument("--min-lines", type=int, default=10)
        s.add_argument("--max-lines", type=int, default=1000)

    add("filter", cmd_filter, land, th, lambda s: s.add_argument("--contents"),
        lambda s: s.add_argument("--out", required=True), lambda s: s.add_argument("--catalog"))
    add("import", cmd_import, land, cat)
    add("crawl", cmd_crawl, th, *[lambda s, n=n: s.add_argument(f"--{n}", required=True) for n in ("repos", "files", "bodies", "out")],
        lambda s: s.add_argument("--url"), lambda s: s.add_argument("--max-repos", type=int, default=5),
        lambda s: s.add_argument("--max-files", type=lambda v: int(v) if v.strip() else None), lambda s: s.add_argument("--min-stars", type=int),
        lambda s: s.add_argument("--license"), lambda s: s.add_argument("--sort", default="stars", choices=["stars", "forks", "updated"]),
        lambda s: s.add_argument("--out-dir", default="collected_code"), lambda s: s.add_argument("--catalog"),
        lambda s: s.add_argument("--format", default="json", choices=["json", "parquet"]))
    add("view", cmd_view, cat, lambda s: s.add_argument("--id", type=int, required=True), lambda s: s.add_argument("--full", action="store_true"))
    add("replace", cmd_replace, cat, lambda s: s.add_argument("--id", type=int, required=True),
        lambda s: s.add_argument("--file"), lambda s: s.add_argument("--text", default=""))
    add("tags", cmd_tags, cat, lambda s: s.add_argument("--limit", type=int, default=CLI_SEARCH_LIMIT))
    add("delete", cmd_delete, cat, lambda s: s.add_argument("--ids", required=True))
    add("search", cmd_search, cat, lambda s: s.add_argument("--query"), lambda s: s.add_argument("--tags"),
        lambda s: s.add_argument("--min-quality", type=float), lambda s: s.add_argument("--suitable-only", action="store_true"),
        lambda s: s.add_argument("--limit", type=int, default=CLI_SEARCH_LIMIT))
    add("tag", cmd_tag, cat, lambda s: s.add_argument("--ids", required=True), lambda s: s.add_argument("--tag", required=True),
        lambda s: s.add_argument("--action", default="add", choices=["add", "remove"]))
    add("stats", cmd_stats, cat)
    add("export", cmd_export, cat, lambda s: s.add_argument("--format", default="csv", choices=["csv", "json"]),
        lambda s: s.add_argument("--out", required=True))
    add("backup", cmd_backup, cat, lambda s: s.add_argument("--out"), lambda s: s.add_argument("--landing"),
        lambda s: s.add_argument("--format", default="json", choices=["json", "parquet"]))
    add("sync", cmd_sync, land, cat, lambda s: s.add_argument("--out", required=True))
    return p


def main(argv=None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    if spark is None:
        from quarry.session import get_session
        spark = get_session()
    args.fn(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
