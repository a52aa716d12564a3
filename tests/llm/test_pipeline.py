"""Every stage against a brute-force version on the smallest tables, and the registry."""

import corpus_pipeline
from conftest import SF001

from .test_decontam import brute as hits
from .test_line_dedup import brute as lines
from .test_ngram_join import brute as near
from .test_quality import figures


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF001)
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        texts = [(k, r["text"]) for k, r in before.items()]
        if name == "quality rules":
            assert not [k for k in after if figures(before[k]["text"])[5]]
        elif name == "line dedup":
            assert sorted(((k, r["text"]) for k, r in after.items()), key=repr) == [x[:2] for x in lines(texts)]
        elif name == "n-gram Jaccard join":
            assert set(after) == {k for k, _, c in near(texts) if k == c}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
            assert set(after) == {x[0] for x in hits(texts, items) if not x[4]}
        docs = spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].split()) for r in after.values())


def test_registered():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in q and set(o) <= set(q)
