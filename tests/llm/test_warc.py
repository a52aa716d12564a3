import gzip
import hashlib
import io
import json
import zlib

import pytest

from quarry.llm import warc as W


def rows():
    big = "<p>same page</p>" * 20
    return [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://b/2", None), (4, "http://b/4", "small"), (5, "http://b/5", "small"),
            (6, "http://c/6\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 50), (7, None, "x" * 3_000_000), (None, "u", big), (8, "http://d", "")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*x, 1) for x in rows()], "page_id bigint, url string, html string, digest int").repartition(2)
    folder, index = W.archive_pages(df, root=str(tmp_path))
    got = {r["page_id"]: r for r in W.read_records(index).collect()}
    assert len(got) == len(rows())
    for k, url, html in rows():
        payload = (html or "").encode()
        r = got[None if k is None else str(k)]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = k in (3, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", "1") if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
        assert r["url"] == (url or "").replace("\r", "%0D").replace("\n", "%0A")
    # each record is a member of its own, at the offset that index and sidecar tell
    for path in {r["archive"] for r in index.collect()}:
        data = open(path, "rb").read()
        entries = [json.loads(x) for x in open(f"{path}.index.jsonl")]
        assert [e["offset"] for e in entries] == sorted(r["offset"] for r in index.collect() if r["archive"] == path)
        for e in entries:
            unzip = zlib.decompressobj(wbits=31)
            record = unzip.decompress(data[e["offset"]:e["offset"] + e["length"]])
            assert unzip.eof and not unzip.unused_data and record.startswith(b"WARC/1.1\r\n")
        assert sum(e["length"] for e in entries) == len(data)


def test_several_archives_per_task(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "p" * 5000) for i in range(30)], "page_id int, url string, html string").coalesce(1)
    typed = W.with_types(df, "page_id", "url", "html", least_bytes=10_000)
    found = W.write_archives(typed, str(tmp_path), archive_bytes=20_000)
    found = spark.createDataFrame(found.collect())
    assert found.count() > 3
    index = W.normalise(found, str(tmp_path / "members"))
    assert sorted(int(r["page_id"]) for r in W.read_records(spark.createDataFrame(index.collect())).collect()) == list(range(30))


def test_streams():
    records = [W.record(str(i), "u", b"x" * i * 1000, "d", None) for i in range(5)]
    whole = gzip.compress(b"".join(records))
    members = b"".join(map(gzip.compress, records))
    for data in (whole, members):
        assert list(W.records_of(W.inflate(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        list(W.records_of(iter([b"".join(records)[:-2000]])))
    for cut in (whole[:-4], whole[:-8], members[:-3]):                     # between records, but before the stream's end
        with pytest.raises(ValueError, match="cut off"):
            list(W.records_of(W.inflate(io.BytesIO(cut))))
    with pytest.raises(ValueError):
        list(W.records_of(iter([b"garbage\r\n\r\n"])))


def test_empty_and_repeated(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200)], "page_id int, url string, html string")
    _, index = W.archive_pages(df)
    assert sorted(r["record_type"] for r in W.read_records(index).collect()) == ["response", "response"]
    _, index = W.archive_pages(df.limit(0))
    assert W.read_records(index).count() == 0
