r"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is compiled into a deterministic transducer over
bytes. Let t(i) be the last token of the encoding of a pretoken's first i bytes:
it is the only token that ends there and can follow t(i - its length), where one
token can follow another if no merge rule fires across their border. So the
count after i bytes is one more than the count before that token. A state keeps,
for each place from which a token may still be running, the place's trie node,
last token and count relative to now; a transition on a byte is annotated with
the change in the number of tokens emitted. States are determinised when first
met and kept; beyond MAX_TRANSITIONS the table starts anew.

Pretokens come from the vocabulary's splitting pattern, at whose borders the
transducer is in its start state. Long texts are cut into chunks at any place. A
chunk's state map is constant between its first and last *synchronising* place
(white space behind other characters, where a pretoken ends whatever came
before): it is held as the open head, the count between, and the open tail.
Maps compose associatively, so a scan over chunks, pair by pair, gives the
text's count. Texts over SPREAD code points have their chunks dealt out to many
tasks and composed per text.

Added tokens inside a text (such as an end-of-text mark) count as one token
each, as the library does by default. A null text is empty and has no tokens.
Rows are counted each for itself; repeated rows and null ids pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import keyed_text, python_ready
from quarry.llm.words import slices

CHUNK = 1 << 15            # code points
SPREAD = 1 << 20
MAX_TRANSITIONS = 1 << 20
MAX_PRETOKENS = 1 << 18
NEVER = 1 << 40
# fixed value: the splitting pattern of the byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SYNC = regex.compile(r"(?<=\S)\s")


def byte_of_char() -> dict[str, int]:
    """Vocabulary files write bytes as characters: printable ones as themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts the tokens of a pretoken, byte by byte."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        ids = {bytes([b]): b for b in range(256)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * 256                        # rank of the rule that makes a token
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        for r, (a, b) in enumerate(merges):
            pair = ids[a], ids[b]
            self.rank[pair] = r
            if a + b not in ids:
                ids[a + b] = len(self.made)
                self.made.append(r)
                self.halves.append(pair)
        self.children: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, i in ids.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.children:
                    self.children[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.children[key]
            self.token[node] = i
        self.spines: dict[tuple[int, int], list[int]] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.next: dict[int, tuple[int, int]] = {}

    def spine(self, token: int, side: int) -> list[int]:
        """Tokens at the left (0) or right (1) end of `token` as its rules fire, from the byte up."""
        key = token, side
        if key not in self.spines:
            out = [token]
            while self.halves[out[-1]][0] >= 0:
                out.append(self.halves[out[-1]][side])
            self.spines[key] = out[::-1]
        return self.spines[key]

    def can_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of both strings together keeps their border."""
        key = a, b
        if key in self.follows:
            return self.follows[key]
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            grow_left = self.made[left[i + 1]] if i + 1 < len(left) else NEVER
            grow_right = self.made[right[j + 1]] if j + 1 < len(right) else NEVER
            across = self.rank.get((left[i], right[j]), NEVER)
            # of equal rules the leftmost fires first
            if across < grow_left and across <= grow_right and across < NEVER:
                good = False
                break
            if grow_left == grow_right == NEVER:
                good = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.follows) >= MAX_TRANSITIONS:
            self.follows.clear()
        self.follows[key] = good
        return good

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        running, last, change = [], -1, 0
        for node, before, count in self.states[state]:
            node = self.children.get(node << 8 | byte, -1)
            if node < 0:
                continue
            t = self.token[node]
            if last < 0 <= t and (before < 0 or self.can_follow(before, t)):
                last, change = t, count + 1
            if self.inner[node]:
                running.append((node, before, count))
        target = (*((n, b, c - change) for n, b, c in running), (0, last, 0))
        if target not in self.number:
            self.number[target] = len(self.states)
            self.states.append(target)
        self.next[state << 8 | byte] = out = self.number[target], change
        return out

    def count(self, pretoken: bytes) -> int:
        if len(self.next) > MAX_TRANSITIONS:
            self.reset()
        state = total = 0
        known = self.next
        for byte in pretoken:
            step = known.get(state << 8 | byte)
            state, change = step if step is not None else self.compile(state, byte)
            total += change
        return total


class Pretokens(dict):
    """Composed maps of whole pretokens, start state to start state: their counts."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, pretoken: str) -> int:
        n = self.transducer.count(pretoken.encode())
        if len(pretoken) <= 64:
            self[pretoken] = n
        return n


class Counter:
    """Counts tokens of texts by one tokenizer file."""

    def __init__(self, spec: dict):
        chars = byte_of_char()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pretokens = Pretokens(Transducer([(as_bytes(a), as_bytes(b)) for a, b in merges]))
        self.split = regex.compile(PATTERN)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def whole(self, text: str) -> int:
        """Tokens of a text that starts and ends where a pretoken does."""
        if len(self.pretokens) > MAX_PRETOKENS:
            self.pretokens.clear()
        return sum(map(self.pretokens.__getitem__, self.split.findall(text)))

    def chunk(self, text: str) -> tuple[bool, str, int, str]:
        """State map of a chunk: (closed, open head, count between, open tail); head only, if nothing synchronises."""
        first = SYNC.search(text)
        if first is None:
            return False, text, 0, ""
        a, b = first.start(), max(m.start() for m in SYNC.finditer(text, pos=max(first.start(), 0)))
        return True, text[:a], self.whole(text[a:b]), text[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The map of two adjacent chunks."""
        if not x[0]:
            return y[0], x[1] + y[1], y[2], y[3]
        if not y[0]:
            return True, x[1], x[2], x[3] + y[1]
        return True, x[1], x[2] + self.whole(x[3] + y[1]) + y[2], y[3]

    def scan(self, maps: list[tuple]) -> int:
        """Count of the text whose chunks have these maps; composed pair by pair."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        _, head, between, tail = maps[0] if maps else (False, "", 0, "")
        return self.whole(head) + between + self.whole(tail)

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Added tokens found, and the stretches between them."""
        if self.added is None:
            return 0, [text]
        parts = self.added.split(text)
        return len(parts) - 1, parts

    def count(self, text: str) -> int:
        found, parts = self.pieces(text)
        for part in parts:
            if len(part) <= CHUNK:
                found += self.whole(part)
            else:
                found += self.scan([self.chunk(part[i:i + CHUNK]) for i in range(0, len(part), CHUNK)])
        return found


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for a tokenizer file."""
    if path not in _COUNTERS:
        with open(path, encoding="utf-8") as f:
            _COUNTERS[path] = Counter(json.load(f))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; `path` names the tokenizer file on every machine."""
    python_ready(docs.sparkSession)
    rows = keyed_text(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array([c.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                found, parts = c.pieces(t)
                yield _maps([(row, -1, 0, found, False, "", 0, "")])
                for k, p in enumerate(parts):
                    for i in range(0, len(p), CHUNK):
                        yield _maps([(row, k, i, 0, False, p[i:i + CHUNK], 0, "")])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for r in batch.to_pylist():
                m = c.chunk(r["head"]) if r["part"] >= 0 else (False, "", 0, "")
                yield _maps([(r["row"], r["part"], r["at"], r["found"], *m)])

    def composed(t: pa.Table) -> pa.Table:
        c = counter(path)
        parts: dict[int, list] = {}
        found = 0
        for r in sorted(t.to_pylist(), key=lambda r: (r["part"], r["at"])):
            found += r["found"]
            parts.setdefault(r["part"], []).append((r["closed"], r["head"], r["n"], r["tail"]))
        found += sum(c.scan(maps) for maps in parts.values())
        return pa.table({"row": t.column("row")[:1], "n_tokens": pa.array([found], pa.int64())})

    size = F.length("text")
    short = rows.filter(size <= spread).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    long = rows.filter(size > spread).withColumn("row", F.sha2("text", 256))      # equal texts have equal counts
    chunks = long.dropDuplicates(["row"]).select("row", "text").mapInArrow(cut, _MAPS).repartition("row", "part", "at")
    counts = chunks.mapInArrow(mapped, _MAPS).groupBy("row").applyInArrow(composed, "row string, n_tokens bigint")
    spread_out = long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "row").join(counts, "row")
    return short.unionByName(spread_out.select("doc_id", "n_bytes", "n_tokens"))


_MAPS = "row string, part int, at bigint, found bigint, closed boolean, head string, n bigint, tail string"


def _maps(rows: list[tuple]) -> pa.RecordBatch:
    names = ["row", "part", "at", "found", "closed", "head", "n", "tail"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
