import random

import pytest

from quarry.llm import ngram_join as J


def brute(rows):
    """Sets and components by comparing every pair."""
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, k), k)
    return sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=60)
    rows = []
    for g in range(14):
        base = r.choices(vocab, k=r.choice([1, 3, 5, 12, 60, 200]))
        for _ in range(r.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w + passage
            rows.append(" ".join(w).replace("w1", "W1") if r.random() < 0.2 else " ".join(w))
    rows += [None, "", " \n\t", "one two", "One TWO", "a b c d e", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block_sets", [1000, 12])
def test_components_match_all_pairs(spark, block_sets):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(x) for x in J.ngram_components(df, block_sets=block_sets).collect())
    assert got == brute(rows)


def test_empty_table_repeats_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, cls int")
    assert J.ngram_components(empty).count() == 0
    rows = [(3, "a b c d e f", 1), (3, "a b c d e f", 1), (1, "a b c d e f", 2), (None, "x y", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cls int")
    got = sorted((tuple(x) for x in J.ngram_components(df).collect()), key=repr)
    assert got == sorted([(3, 2, 1), (3, 2, 1), (1, 2, 1), (None, 1, None)], key=repr)
    kept = sorted((tuple(x) for x in J.keep_first(df).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f", 2), (None, "x y", 3)], key=repr)


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "t" * 3_000_000)], "doc_id bigint, text string")
    got = sorted(tuple(x) for x in J.ngram_components(df).collect())
    assert got == [(1, 59_996, 1), (2, 59_997, 1), (3, 1, 3)]
