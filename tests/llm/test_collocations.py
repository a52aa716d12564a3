import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations as C

SCHEMA = "doc_id int, text string, lang string, phrase string, a int, n string, block int"


def plain(rows, min_count, top):
    """The contract, word by word."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    good = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = []
    for lang in n:
        mine = []
        for (g, words), a in good.items():
            if g != lang:
                continue
            inside = [b for (h, longer), b in good.items() if h == lang and len(longer) > len(words)
                      and any(longer[i:i + len(words)] == words for i in range(len(longer) - len(words) + 1))]
            if any(100 * b >= 50 * a for b in inside):
                continue
            cuts = [(10 ** 6 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
            s, k = min(cuts)
            mine.append((s, a, " ".join(words), f[lang, words[:k]], f[lang, words[k:]]))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(mine[:top])]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "the", "THE", "(x)", "é", "世界", "a-b", "new", "york", "city"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randrange(25)):
            out += ["new", "york", "city"] if r.random() < 0.15 else r.choices(words, weights)
            if r.random() < 0.2:
                out[-1] += r.choice(list(".,;:!?\n\r\x0b"))
        rows.append((i % 70, r.choice([None, "", " ".join(out), "\t".join(out), " ".join(out)]), r.choice(["en", "en", "de", None, "und", ""]), "x", 1, "y", i))
    return rows + rows[:9]


@pytest.mark.parametrize("own, fill, blocks", [(64, 16, None), (1, 1 << 20, 300), (1 << 30, 1 << 20, 300), (1 << 30, 1, 2000)])
def test_equals_plain_version(spark, monkeypatch, own, fill, blocks):
    """Tiles of their own and buckets, dense and sorted counts, one block and many."""
    rows = corpus(3)
    monkeypatch.setattr(C, "OWN_TILES", own)
    if fill == 1:
        monkeypatch.setattr(C, "TILE", 4), monkeypatch.setattr(C, "BITS", 2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5 if blocks else 1)
    got = C.mine(df, min_count=4, top=30).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 30)


def test_tile_dense_and_sorted_agree():
    r = np.random.default_rng(1)
    for size in (50, 400_000, 3_000_000):
        x, y = r.integers(0, 1024, size) + 2048, r.integers(0, 1024, size) + 1024
        keys, n = x << 32 | y, r.integers(1, 5, size)
        for own in (True, False):
            tile = C.Tile()
            for part in range(0, size, 700_000):
                tile.add(keys[part:part + 700_000], n[part:part + 700_000], own)
            got, total = tile.result(own)
            want, at = np.unique(keys, return_inverse=True)
            assert (got == want).all() and (total == np.bincount(at, weights=n)).all()


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.mine(empty).collect() == []
    assert C.mine(spark.createDataFrame([(1, None, None, "", 0, "", 0), (2, "one word", "en", "", 0, "", 0)], SCHEMA)).collect() == []
    rows = [(1, "a b " * 300_000 + "c" * 50_000, "en", "", 0, "", 0), (2, "b a", None, "", 0, "", 0)]
    assert sorted(map(tuple, C.mine(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows, 10, 2000)


def test_large_counts_are_exact(spark):
    a, l, r = 3_000_000_000_000_001, 3_000_000_000_000_007, 3_000_000_000_000_019
    got = spark.range(1).select(*[F.lit(v).alias(c) for c, v in zip("alr", (a, l, r))]) \
        .select(C.score(*map(F.col, "alr"))).first()[0]
    assert got == 10 ** 6 * a * a // (l * r)
