import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import words as W

TEXT = st.text(st.sampled_from(list("aAbZ09 \t\n\x0b\x0c\r\x1c\xa0.,-éÉ中\U0001F600\x00\x7f")), max_size=40)


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.booleans())
def test_words_and_hashes(texts, alnum):
    breaks, pattern = (W.NOT_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") if alnum else (W.WHITE_SPACE, r"[^\x20\x09-\x0D]+")
    buf, off = W.text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows = W.find_words(buf, off, breaks)
    got = [low(bytes(buf[a:b]).decode()) for a, b in zip(starts, ends)]
    want = [re.findall(pattern, low(t or "")) for t in texts]
    assert got == [w for ws in want for w in ws]
    assert list(np.diff(rows)) == [len(ws) for ws in want]
    hashes = W.hash_words(buf, starts, ends).tolist()
    assert len(set(zip(got, hashes))) == len(set(got)) == len(set(hashes))


def test_hashes_do_not_depend_on_place(monkeypatch):
    r = random.Random(1)
    text = " ".join("".join(r.choices("abcdé", k=r.randrange(1, 9))) for _ in range(3000))
    buf, off = W.text_buffer(pa.array([text]))
    starts, ends, _ = W.find_words(buf, off, W.WHITE_SPACE)
    whole = W.hash_words(buf, starts, ends)
    monkeypatch.setattr(W, "SEGMENT", 64)
    assert (W.hash_words(buf, starts, ends) == whole).all()
    windows = W.hash_windows(whole, 5)
    assert windows[7] == W.one_hash(whole[7:12]) and len(windows) == len(whole) - 4
    assert len(W.hash_windows(whole[:3], 5)) == 0


def test_slices_and_sliced_arrays():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c d"])], ["text"])
    parts = list(W.slices(batch, "text", 12))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    buf, off = W.text_buffer(parts[2].column("text"))
    assert bytes(buf) == b"c d" and list(off) == [0, 0, 3]
    assert list(W.slices(batch.slice(0, 0), "text")) == []
