import random
import re
from collections import Counter

import pytest

from quarry.llm import divergence as D

SCHEMA = "doc_id int, text string, lang string, source string, term string, p int, block string"


def plain(rows, min_docs, top):
    """The contract, word by word."""
    occ, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        for t in terms:
            occ[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= min_docs)
        sources = [s for l, s in groups if l == lang]
        p = {}
        for s in [*sources, None]:
            c = {t: sum(occ[lang, x, t] for x in (sources if s is None else [s])) for t in kept}
            total = sum(c.values())
            p[s] = {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}, c

        def f(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][0][t], p[o][0][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][0][t], p[None][0][t])) for t in kept if p[s][1][t] > 0 and p[s][0][t] > p[None][0][t]]
            for part, found, n in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found[:n])]
    return sorted(out)


def corpus(seed, n=150):
    r = random.Random(seed)
    words = ["the", "of", "Café", "naïve", "x1y", "don't", "end.", "(end)", "END", "a-b-a", "世界", "q", "--", "7", "ß", " w"]
    rows = []
    for i in range(n):
        body = r.choice([" ", "\n", "\t "]).join(r.choices(words, k=r.randrange(30)))
        rows.append((i % 40, r.choice([None, "", body, body, body]), r.choice(["en", "en", "de", None, "fr"]),
                     r.choice(["hot", "hot", "hot", *(f"s{k}" for k in range(9)), None]), "clash", i, "b"))
    return rows + rows[:5]


@pytest.mark.parametrize("tiles, sides", [(4096, 256), (3, 2)])
def test_equals_plain_version(spark, tiles, sides):
    rows = corpus(1)
    got = D.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=4, top=3, tile_terms=tiles, source_block=sides).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 3)


def test_language_without_kept_terms(spark):
    rows = [(1, "a b", "en", "x", "", 0, ""), (2, "", "en", "y", "", 0, ""), (3, None, None, None, "", 0, "")]
    got = D.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert D.audit(empty).collect() == []
    rows = [(1, "word " * 200_000 + "x" * 100_000, "en", "a", "", 0, "")] * 2 + [(2, "word", "en", "b", "", 0, "")]
    assert sorted(map(tuple, D.audit(spark.createDataFrame(rows, SCHEMA), min_docs=2).collect())) == plain(rows, 2, 10)


def test_blocks_cut_inside_a_task():
    from quarry.llm import blocks
    rows = corpus(2, 60)
    cut = [b for b in blocks.gather(iter(_batches(rows)), "text", 200)]
    assert sum(b.num_rows for _, b in cut) == len(rows) and len(cut) > 5 and len({i for i, _ in cut}) == len(cut)


def _batches(rows):
    import pyarrow as pa
    return pa.table({"text": pa.array([r[1] for r in rows], pa.string())}).to_batches(max_chunksize=7)
