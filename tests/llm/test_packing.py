import itertools
import random
from collections import defaultdict

import pytest

from quarry.llm import packing as P


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_optimal(seed):
    r = random.Random(seed)
    lengths = r.sample(range(0, 60), 9)
    counts = [r.randrange(1, 50) for _ in lengths]
    for k in (1, 2, 4, 20):
        best = min(padding(lengths, counts, [*c, max(lengths)]) for n in range(min(k, len(lengths)))
                   for c in itertools.combinations(sorted(lengths)[:-1], n))
        got = P.bucket_lengths(lengths, counts, k)
        assert len(got) <= k and padding(lengths, counts, got) == best


def test_batches(spark):
    r = random.Random(1)
    docs = [(i, " ".join(["w"] * r.choice([1, 2, 7, 30, 90, 130]))) for i in range(400)] + [(500, None), (501, ""), (None, "a b"), (7, "a b c"), (7, "a b c")]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id int, text string, bucket int").repartition(5)
    got = P.pack(df, max_len=64, buckets=4, budget=200, shard_rows=20).collect()
    per = defaultdict(list)
    for x in got:
        per[x["doc_id"]].append((x["start"], x["n_tokens"]))
    for k, t in docs:
        n = len((t or "").split())
        if k not in (7,):
            assert sorted(per[k]) == [(s, min(64, n - s)) for s in range(0, max(n, 1), 64)]
    lens = sorted({x["bucket_len"] for x in got})
    assert len(lens) <= 4 and lens[-1] == 64
    hist = defaultdict(int)
    for x in got:
        hist[x["n_tokens"]] += 1
        assert x["bucket_len"] == min(b for b in lens if b >= x["n_tokens"])
    assert lens == sorted({max(1, b) for b in P.bucket_lengths(list(hist), list(hist.values()), 4)})
    batches = defaultdict(list)
    for x in got:
        batches[x["bucket"], x["batch"]].append(x["slot"])
    for (b, n), slots in batches.items():
        size = 200 // lens[b]
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= size
        assert len(slots) == size or n == max(m for c, m in batches if c == b)
    assert P.pack(df.limit(0)).count() == 0


def test_long_text_and_given_lengths(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "w " * 100_000, 5)], "doc_id int, text string, n int")
    assert P.pack(df).agg(F.sum("n_tokens"), F.count("*")).first() == (100_000, 49)
    assert P.pack(df, length=F.col("n")).first()["n_tokens"] == 5
