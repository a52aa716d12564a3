import re
from collections import Counter

from quarry.llm import quality as Q

WHITE = r"[\x20\x09-\x0D]+"


def figures(text):
    """Plain version of the contract's figures."""
    text = text or ""
    w = [x for x in re.split(WHITE, text) if x]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


PROSE = "The quick brown fox, having slept well, jumps over the lazy dog near the old river bank today.\n" \
        "A second line of prose follows it, and it is not like the first one at all."
TEXTS = [None, "", " \t\n", "one", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 9, "x\n" * 40, "é ü ß " * 30 + ".",
         "\U0001F600 " * 25, "a|b|c|d|e\n" * 30, "HELLO WORLD THIS IS ALL VERY LOUD TEXT\n" + PROSE,
         " ".join(f"w{i}" for i in range(5000)) + "."]


def test_figures(spark):
    rows = list(enumerate(TEXTS)) + [(None, PROSE), (4, PROSE)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id int, text string, kept string, n_words int")
    got = Q.measure(df).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r["doc_id"], *(r[c] for c in cols)) for r in got], key=repr) \
        == sorted([(k, *figures(t)) for k, t in rows], key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[4] and kept[None] and not kept[0] and not kept[6] and not kept[10] and kept[11]


def test_line_rules(spark):
    body = "\n".join(f"Sentence{i} number{i} says{i} something{i}, and it{i} ends{i} here." for i in range(20))
    lines = ["Home | About | Contact | Help", "All rights reserved.", "word " * 15, "%%% a *** b ### c $$$ d", "WE SHOUT AT YOU ALL DAY LONG NOW!"]
    text = "\n".join([body, *lines])
    df = spark.createDataFrame([(1, text, len(text))], "doc_id int, text string, n_chars int")
    row = Q.clean(df).first()
    assert row["text"] == body and row["n_chars"] == len(body)


def test_clean_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, PROSE, "a", 3), (1, PROSE, "a", 3), (2, "too short", "b", 9)], "doc_id int, text string, doc_name string, __left int")
    assert sorted(tuple(r) for r in Q.clean(df).collect()) == [(1, PROSE, "a", 3)] * 2
    assert Q.clean(df.limit(0)).columns == df.columns and Q.measure(df.limit(0)).count() == 0


def test_lines_in_other_scripts_stay(spark):
    lines = ["어제 저녁 KBS 뉴스 에서 새로운 소식 을 전했다 그리고 많은 사람 들이 보았다.",                      # capitals among letters without case
             "أعلن حلف NATO اليوم عن خطة جديدة للتعاون بين الدول الأعضاء في المنطقة،",
             "הארגון NATO הודיע היום על תוכנית חדשה לשיתוף פעולה בין המדינות.",
             "यह एक लंबा वाक्य है जिसमें बहुत सारे शब्द हैं और अंत में दंड है।",                                   # a danda is the only mark
             "یہ ایک لمبا جملہ ہے جس میں بہت سے الفاظ ہیں اور آخر میں نشان ہے۔",
             "هل تعرف ما هي هذه الخطة الجديدة التي أعلن عنها اليوم في كل مكان هنا؟",
             "วันนี้ อากาศ ดี มาก เรา ไป เที่ยว ทะเล กับ เพื่อน หลาย คน และ กลับ บ้าน เย็น"]
    bad = ["WE SHOUT AT YOU ALL DAY LONG NOW!", "МЫ КРИЧИМ НА ВАС ВЕСЬ ДЕНЬ И ВСЮ НОЧЬ!", "WE SHOUT AT YOU ALL DAY LONG IN 東京!",
           " ".join(f"word{i}" for i in range(15)), " ".join(f"слово{i}" for i in range(15)), "यह एक लंबा वाक्य है जिसमें बहुत सारे शब्द हैं और अंत में कुछ नहीं"]
    df = spark.createDataFrame([(1, "\n".join(lines + bad)), (2, "\n".join(lines))], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in Q.clean(df).collect()} == dict.fromkeys((1, 2), "\n".join(lines))
