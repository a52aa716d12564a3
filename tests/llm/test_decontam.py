import random
import re

import pytest

from quarry.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if k is None else str(k))
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((k, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def tables():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(50)] + ["Äß", "x y", "\U0001F600"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([2, 5, 13, 14, 40])))) for i in range(25)] + [(None, "alpha beta gamma"), (77, None), (78, " .,; "), (3, "same id again here")]
    docs = []
    for i in range(80):
        w = r.choices(vocab, k=r.choice([0, 3, 20, 300]))
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w) + 1):0] = ["--"] + (r.choice(items)[1] or "").upper().split()
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(None, "ALPHA beta-gamma!"), (90, None), (91, ""), (5, docs[5][1]), (92, "z " * 100_000 + items[3][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 500])
def test_flags_match_brute_force(spark, block_bytes):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string")
    got = D.flag(d, b, block_bytes=block_bytes).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got], key=repr) == brute(docs, items)


def test_spans_and_removal(spark):
    b = spark.createDataFrame([(1, "one two three"), (2, "três é")], "item_id int, text string")
    rows = [(1, "Äh, ONE-two, three! bye", 1), (2, "clean text", 2), (3, "a " * 100 + "três É", 3), (4, "x", 4), (5, "one two three " + "b " * 90, 5)]
    d = spark.createDataFrame(rows, "doc_id int, text string, n_hit int")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in D.flag(d, b).collect()}
    assert spans == {1: [(4, 18)], 2: [], 3: [], 4: [], 5: [(0, 13)]}
    assert sorted(r["doc_id"] for r in D.remove(d, b).collect()) == [2, 3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in D.remove(d, b, spans_only=True).collect()}
    assert cut[1] == "Äh, ! bye" and cut[2] == "clean text" and cut[5] == rows[4][1][13:]
    assert D.remove(d, b).columns == d.columns
    assert D.flag(d.limit(0), b).count() == 0 and D.remove(d, b.limit(0)).count() == 5
