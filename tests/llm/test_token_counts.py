import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return T.counter(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def texts():
    r = random.Random(6)
    chars = list("abcdefghijklmnopqrstuvwxyzABC  \n\t'.,!?0123456789éßñ中文 　\U0001F600½²")
    out = ["", " ", "\n\n x", "don't we'll I'd 's 've''s 'S", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "   lead", "trail   ", "a" * 300, "ab" * 200]
    out += ["".join(r.choices(chars, k=r.randrange(1, 60))) for _ in range(3000)]
    out += ["".join(r.choices("aehinorst ", k=200)) for _ in range(500)]
    return out + [" ".join(bytes(r.choices(range(1, 255), k=30)).decode("latin-1") for _ in range(3)) for _ in range(300)]


def test_counts_equal_the_library(counter, library):
    t = texts()
    assert [counter.count(x) for x in t] == expected(library, t)


def test_every_token_and_pairs_of_tokens(counter, library):
    with open(PATH, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    chars = T.byte_of_char()
    words = [bytes(chars[c] for c in t).decode("utf-8", "ignore") for t in vocab]
    r = random.Random(7)
    t = [w for w in words if w] + ["".join(r.choices(words, k=3)) for _ in range(20_000)]
    assert [counter.count(x) for x in t] == expected(library, t)


def test_classes_of_all_characters(counter, library):
    """Borders fall as the library's do for every assigned character."""
    t = [f"a{chr(c)}1 {chr(c)}.{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = [x for x, a, b in zip(t, (counter.count(x) for x in t), expected(library, t)) if a != b]
    # characters newer than one of the two Unicode tables
    assert len(wrong) < 0.02 * len(t)
    import unicodedata
    old = [x for x in wrong if unicodedata.ucd_3_2_0.category(x[1]) != "Cn"]
    assert not old


@pytest.mark.parametrize("size", [1, 7, 50])
def test_chunk_maps_compose(counter, library, size):
    r = random.Random(8)
    t = [x for x in texts() if "<|" not in x][:400] + ["the end of it all " * 20, "x" * 100, " " * 60, "\n \n a b\t\tc  "]
    for x, n in zip(t, expected(library, t)):
        maps = [counter.chunk(x[i:i + size]) for i in range(0, len(x), size)]
        assert counter.scan(maps) == n
        while len(maps) > 1:                      # any order of composition
            i = r.randrange(len(maps) - 1)
            maps[i:i + 2] = [counter.compose(maps[i], maps[i + 1])]
        assert counter.scan(maps) == n


def test_table(spark, library, monkeypatch):
    long = "the quick brown fox, it's 42 " * 3000
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (None, "", "z"), (3, long, "q"), (4, long, "q"), (5, long + "<|endoftext|>" + long, "r")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    want = sorted(((k, len((t or "").encode()), n) for (k, t, _), n in zip(rows, expected(library, [t or "" for _, t, _ in rows]))), key=repr)
    for spread in (T.SPREAD, 1000):
        assert sorted((tuple(r) for r in T.count_tokens(df, PATH, spread=spread).collect()), key=repr) == want
    assert T.count_tokens(df.limit(0), PATH).count() == 0
