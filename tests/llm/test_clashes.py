"""Columns of the input whose names operators use inside; one rule in two dialects; items that repeat or are long."""

import duckdb

from quarry.llm import decontam, line_dedup, ngram_join, quality
from quarry.llm import sql as S

PROSE = "The quick brown fox, having slept well, jumps over the lazy dog near the old river bank today."
NAMES = "doc_id int, text string, n_chars int, n_lines int, n_dropped int, `__hit` int, `__words` string, row string, id int, gone int, c0 int, `a.b` int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 0, 7, 8, 9, "w", "r", 10, 11, 12, 13) for i, t in enumerate(texts)], NAMES)


def rest(rows, but=()):
    return [tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars", *but)) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_stages_give_back_columns_of_any_name(spark):
    line = "A line that is found in two of the documents."
    df = docs(spark, [PROSE + "\n" + line, PROSE + " And more of it.\n" + line, None])
    bench = spark.createDataFrame([(1, PROSE)], "item_id int, text string")
    whole = rest(df.collect())
    kept = line_dedup.without_repeats(df)
    assert kept.columns == df.columns and rest(kept.collect()) == whole
    assert {r["doc_id"]: r["n_chars"] for r in kept.collect()}[1] == len(PROSE + " And more of it.")
    counted = line_dedup.dedup_lines(df)
    assert counted.columns == [c for c in df.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert [(r["n_lines"], r["n_dropped"]) for r in sorted(counted.collect(), key=lambda r: r["doc_id"])] == [(2, 0), (2, 1), (1, 0)]
    for spans in (False, True):
        clean = decontam.remove(df, bench, spans_only=spans)
        assert clean.columns == df.columns and rest(clean.collect()) == (whole if spans else whole[2:])
    first = ngram_join.keep_first(df)
    assert first.columns == df.columns and set(rest(first.collect())) <= set(whole)
    good = quality.clean(docs(spark, [(PROSE + " ") * 1 + "It went on and on, and it never came to any end at all there.", "short"]))
    assert good.columns == df.columns and rest(good.collect()) == whole[:1]


def test_only_a_text_column(spark):
    bench = spark.createDataFrame([(1, PROSE)], "item_id int, text string")
    df = spark.createDataFrame([(PROSE,), ("clean words",)], "text string")
    assert [tuple(r) for r in decontam.remove(df, bench).collect()] == [("clean words",)]


def test_repeated_and_long_items(spark):
    words = [f"w{i}" for i in range(20_000)]
    items = [(k % 3, " ".join(words[:400])) for k in range(64)] + [(9, "- ".join(words)), (None, ""), (8, "w5 W6")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = decontam._pieces(bench.selectExpr("coalesce(cast(item_id as string), '') id", "coalesce(text, '') body"), 13).collect()
    assert len(rows) == 3 + 5 + 2 and max(len(r["body"]) for r in rows) < 40_000
    texts = [" ".join(words[a:a + 13]) for a in (0, 4083, 4084, 4090, 4095, 4096, 8190, 19_987)] + [" ".join(words[4090:4102]) + " x", "w5 w6"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size in (1 << 24, 30_000):
        got = {r["doc_id"]: r for r in decontam.flag(df, bench, block_bytes=size).collect()}
        assert all(got[i]["n_hit"] == 13 and "9" in got[i]["items"] for i in range(8)) and got[0]["items"] == ["0", "1", "2", "8", "9"]
        assert got[8]["n_hit"] == 0 and got[9]["items"] == ["8"]


def test_quality_rule_is_its_sql(spark):
    """Texts in scripts whose lines the rule judges in other ways than Latin ones."""
    bodies = ["어제 저녁 KBS 뉴스 에서 새로운 소식 을 전했다 그리고 많은 사람 들이 보았다.", "뉴스 KBS 에서 소식 전했다 많은 사람 들이 보았다 어제 저녁 모두 함께",
              "यह एक लंबा वाक्य है जिसमें बहुत सारे शब्द हैं और अंत में दंड है।", "यह एक लंबा वाक्य है जिसमें बहुत सारे शब्द हैं और अंत में कुछ नहीं",
              "هل تعرف ما هي هذه الخطة الجديدة التي أعلن عنها اليوم في كل مكان هنا؟", "أعلن حلف NATO اليوم عن خطة جديدة للتعاون بين الدول الأعضاء في المنطقة",
              "วันนี้ อากาศ ดี มาก เรา ไป เที่ยว ทะเล กับ เพื่อน หลาย คน และ กลับ บ้าน เย็น", "МЫ КРИЧИМ НА ВАС ВЕСЬ ДЕНЬ И ВСЮ НОЧЬ!",
              "WE SHOUT AT YOU ALL DAY LONG IN 東京!", "הארגון NATO הודיע היום על תוכנית חדשה לשיתוף פעולה בין המדינות.", PROSE, PROSE.upper(),
              "a | b | c | d", "all rights reserved", "x### y*** z%%% w$$$"]
    texts = [f"{a}\n{b} {i} " + " ".join(f"q{i}x{k}" for k in range(12)) + "." for i, a in enumerate(bodies) for b in bodies]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({S.QUALITY})").fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in quality.measure(df).collect())
    assert got == want and len({r[-2] for r in got}) == 2
