import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from quarry.llm import rule_ensemble as R

GOOD = "The quick brown fox jumped over {} lazy dogs. It then slept in the old barn, and dreamt of {} hens.\nSo it went on."
BAD = ["{} ".format("spam") * 30, "a | {} | b | c | d | e | f | {}", "WHAT!! IS!! {}!! THIS!! {}!! NOISE!!", "x### y*** {}%%% z$$$ {}&&&"]


def corpus(n=400):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 1
        docs.append((i, (BAD[i // 5 % 4] if bad else GOOD).format(i, i * 7), "en", f"s{i}", 0.5, i))
        labels.append((i, 0 if bad else 1, 0, "x"))
    return docs, labels


DOCS = "doc_id int, text string, lang string, source string, score double, label int"
LABELS = "doc_id int, quality int, toxic int, text string"


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def test_learns_and_keeps_labels_out(spark):
    docs, labels = corpus()
    extra = [(None, None, None, None, None, None), (1000, "", "de", "q", 0.0, 1), (1001, GOOD * 3000, "en", "q", 0.0, 1), docs[3], docs[3]]
    frame = spark.createDataFrame(docs + extra, DOCS).repartition(3)
    got = R.classify(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {i: q for i, q, *_ in labels}
    unseen = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(unseen) > 60 and np.mean([p == q for p, q in unseen]) > 0.95
    assert len({(r["score"], r["predicted"]) for r in got if r["doc_id"] == 3}) == 1
    # other labels of held-out rows, other languages and sources change nothing
    flipped = [(i, 1 - q if held_out(i) else q, 1, "y") for i, q, *_ in labels]
    again = R.classify(frame.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}), spark.createDataFrame(flipped, LABELS)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "")], [(1, None, 0, ""), (77, 1, 0, "")]])
def test_without_two_classes(spark, labels):
    docs = spark.createDataFrame([(1, GOOD, "", "", 0.0, 0), (2, None, None, None, None, None)], DOCS)
    used = [q for i, q, *_ in labels if q is not None and i in (1, 2) and not held_out(i)]
    got = R.classify(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {round(r["score"], 9) for r in got} == {round((sum(used) + 1) / (len(used) + 2), 9)}
    assert R.classify(docs.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_figures():
    x = dict(zip(R.FIGURES, R.figures(pa.array(["Ab Ab c!\nAb Ab c!\n7 # |", None])).T))
    assert x["capitals"][0] == 4 / 10 and x["repeats"][0] == 2 / 9 and x["distinct"][0] == 5 / 9 and x["common"][0] == 4 / 9
    assert x["loud"][0] == 2 / 9 and x["bars"][0] == 1 / 9 and x["symbols"][0] == 1 / 9 and x["line_repeats"][0] == 1 / 3
    assert x["line_words"][0] == 3 and all(x[f][1] == 0 for f in R.FIGURES)


def test_compiled_rules_are_the_trees(spark):
    """The expression gives what walking the rules by hand gives."""
    docs, labels = corpus(120)
    stats = R.statistics(spark.createDataFrame(docs, DOCS)).cache()
    model = R.fit(stats, spark.createDataFrame(labels, LABELS))
    assert model.weights
    for r in stats.select("*", model.score().alias("score")).limit(40).collect():
        z = model.base + sum(w for rule, w in model.weights.items() if all((r[f] > b) == above for f, above, b in rule.parts))
        assert abs(1 / (1 + np.exp(-z)) - r["score"]) < 1e-12


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = R.classify(spark.read.parquet(f"{SF01}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert n > 50 and right > 0.93
