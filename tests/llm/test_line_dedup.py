import random

import pytest

from quarry.llm import line_dedup as L


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holder, docs = {}, {}
    for k, t in rows:
        if k is not None:
            for x in (t or "").split("\n"):
                docs.setdefault(key(x), set()).add(k)
    holder = {x: min(d) for x, d in docs.items() if len(d) > 1 and len(x) >= 10}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or holder.get(key(x), k) == k]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(2)
    lines = [f"this is shared line number {i}" for i in range(30)] + ["short", "", "  \t", "ÄÖÜ äöü line \U0001F600 here", "äöü ÄÖÜ line \U0001F600 here"]
    rows = []
    for i in range(60):
        own = r.choices(lines, k=r.randrange(0, 9)) + [f"only document {i} has this"]
        r.shuffle(own)
        rows.append((i * 3, "\n".join(x.upper() if r.random() < 0.2 else " " + x + "\t" if r.random() < 0.2 else x for x in own)))
    rows += [(None, "this is shared line number 1"), (9, "this is shared line number 2\nthis is shared line number 2"), (500, None), (501, ""),
             (rows[3]), (700, "\n" * 5), (800, "x" * 200_000 + "\nthis is shared line number 1\n" * 500)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 3), (7, 2)])
def test_matches_brute_force(spark, batches, fanout, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(L, "FANOUT", fanout)
    got = L.dedup_lines(df, batches=batches).collect()
    assert sorted([(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got], key=repr) == brute(rows)


def test_runs_compact_and_remember(spark):
    store = L.LineRuns(spark, fanout=2)
    try:
        for b in range(5):
            batch = spark.createDataFrame([(b, i, 0) for i in range(b, b + 3)], "doc_id int, k1 bigint, k2 bigint")
            known = {r["k1"]: (r["holder"], r["known"]) for r in store.add(batch).collect()}
            assert known == {i: ((max(0, i - 2), i < b + 2 and b > 0) if b else (0, False)) for i in range(b, b + 3)}
        assert [len(x) for x in store.levels] == [1, 0, 1]
        keys = [r["k1"] for run in store.runs() for r in run.collect()]
        assert sorted(keys) == list(range(7))
    finally:
        store.close()


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a line of text here", 5, "q"), (2, "a line of text here", 6, "r")], "doc_id int, text string, holder int, body string")
    assert sorted(tuple(r) for r in L.dedup_lines(df).collect()) == [(1, "a line of text here", 5, "q", 1, 0), (2, "", 6, "r", 1, 1)]
    assert L.dedup_lines(df.limit(0)).count() == 0
