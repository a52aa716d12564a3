r"""Secret scans with structural confirmation.

Three base kinds are found by pattern, leftmost and non-overlapping per kind:

* ``assign``: ``(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?``
  and a value of six or more of ``[A-Za-z0-9+/_.=-]``, letters in either case;
* ``access``: ``AKIA[A-Z0-9]+`` of 20 or more characters;
* ``hex``: a run ``[0-9a-f]+`` of 24 or more.

Candidates of the other kinds are decoded and parsed, and reported only if their
structure holds:

* ``der``: base64 (also with the url alphabet, or wrapped into lines, their breaks real
  or escaped as ``\n`` or ``\r\n``) or hex of a private key in DER: an RSA, DSA or EC key,
  PKCS #8, or encrypted PKCS #8, with every nested length right;
* ``openssh``: base64 of an ``openssh-key-v1`` file whose length-prefixed fields add up;
* ``jwt``: three base64url parts, the first a JSON object with an ``alg``, the
  second a JSON object, the third empty only where ``alg`` is ``none``.

Spans are code points, end exclusive, ordered by start and then by kind as listed.
A null text is empty. Texts are scanned whole, each for itself; repeated rows,
null ids and other columns do not matter.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.store import keyed_text, python_ready
from quarry.llm.words import slices

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "der", "openssh", "jwt"]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

ASSIGN_NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# what may be decoded: DER starts with a sequence (0x30), the other with its magic word
DER = re.compile(r"M(?:(?<![A-Za-z0-9+/_-]M)|(?<=\\[nrt]M)|(?<=-----M))[A-Za-z0-9+/_-]{30}")
OPENSSH = re.compile(r"b3BlbnNzaC1rZXktdjEA(?:(?<![A-Za-z0-9+/_-].{20})|(?<=\\[nrt].{20})|(?<=-----.{20}))")
# base64 of either alphabet up to the end of a line or the mark that ends a PEM key, and a line break or its escape
LINE = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!----(?:BEGIN|END)))+")
BREAK = re.compile(r"(?:(?:\\+r)?\\+n|\\*\r?\n)[ \t]*")
URL_ALPHABET = str.maketrans("-_", "+/")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9A-Fa-f]{2}){24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[w-z0-9_-][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
MAGIC = b"openssh-key-v1\0"
INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
FIRST, GROW = 256, 4       # characters of a candidate that are read first, and the factor by which more are


def header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at `at`, or None."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at:at + k]), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[at:end], or None where lengths do not add up."""
    out = []
    while at < end:
        x = header(data, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def integer(data: bytes, x: tuple[int, int, int]) -> bool:
    """A DER integer is not empty and has no needless leading byte."""
    _, a, b = x
    return b > a and not (b - a > 1 and (data[a] == 0 and data[a + 1] < 0x80 or data[a] == 0xFF and data[a + 1] >= 0x80))


def algorithm(data: bytes, x: tuple[int, int, int]) -> bool:
    inner = elements(data, x[1], x[2]) if x[0] == SEQUENCE else None
    return bool(inner) and inner[0][0] == OID and inner[0][2] > inner[0][1]


def key_length(data: bytes) -> int | None:
    """Length of the DER private key that `data` starts with, or None."""
    top = header(data, 0, len(data))
    if top is None or top[0] != SEQUENCE:
        return None
    parts = elements(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    if tags[0] == SEQUENCE:                                     # encrypted PKCS #8
        return top[2] if tags == [SEQUENCE, OCTETS] and algorithm(data, parts[0]) else None
    if tags[0] != INTEGER or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return None
    if len(tags) >= 6 and all(t == INTEGER for t in tags[:6]):  # RSA has nine integers, DSA six
        numbers = [x for x in parts if x[0] == INTEGER]
        return top[2] if len(numbers) in (6, 9) and all(integer(data, x) for x in numbers) else None
    if len(tags) >= 3 and tags[1:3] == [SEQUENCE, OCTETS]:      # PKCS #8
        return top[2] if algorithm(data, parts[1]) and parts[2][2] > parts[2][1] else None
    if data[parts[0][1]] == 1 and len(tags) >= 2 and tags[1] == OCTETS and parts[1][2] - parts[1][1] >= 16:   # EC
        return top[2] if all(t in (0xA0, 0xA1) for t in tags[2:]) else None
    return None


def openssh_fields(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the fields of the OpenSSH key file that `data` begins: cipher, kdf, kdf options, then so many
    public keys as a number says, and the private part. Ends before a field whose length is not in `data`."""
    at, left = len(MAGIC), 3
    while left and at + 4 <= len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4])
        yield at + 4, end
        at, left = end, left - 1
        if left == 0 and at + 4 <= len(data):
            keys = int.from_bytes(data[at:at + 4])
            if not 1 <= keys <= 16:
                yield at, -1
                return
            at += 4
            for _ in range(keys + 1):
                if at + 4 > len(data):
                    return
                end = at + 4 + int.from_bytes(data[at:at + 4])
                yield at + 4, end
                at = end
            return


def openssh_reach(data: bytes) -> int | None:
    """Bytes that the OpenSSH key has at least, as far as `data` tells: its length once that is whole; None if it is none."""
    if not data.startswith(MAGIC):
        return None
    found = list(openssh_fields(data))
    if any(b < a or a == b and i != 2 for i, (a, b) in enumerate(found)):
        return None
    at = found[-1][1] if found else len(MAGIC)
    if len(found) < 4:
        return at + (8 if len(found) == 3 else 4)
    first = found[2][1]
    keys = int.from_bytes(data[first:first + 4])
    return at if len(found) == 3 + keys + 1 else at + 4


def openssh_length(data: bytes) -> int | None:
    """Length of the OpenSSH private key file that `data` starts with, or None."""
    n = openssh_reach(data)
    return n if n is not None and n <= len(data) else None


def promised(data: bytes) -> int | None:
    """Length of the DER that `data` begins (21 bytes of it), or None where it cannot be a private key."""
    top = header(data, 0, 1 << 40)
    inner = header(data, top[1], top[2]) if top and top[0] == SEQUENCE else None
    if inner is None or inner[1] >= len(data):
        return None
    first = data[inner[1]]
    return top[2] if inner[0] == SEQUENCE and first == OID or inner[0] == INTEGER and inner[2] - inner[1] == 1 and first <= 1 else None


def gather(text: str, at: int, need: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to `need` base64 characters from `at` on, over line breaks, and (number, end) after each line."""
    parts, n, ends = [], 0, []
    while n < need:
        m = LINE.match(text, at, at + need - n + 16)
        if m is None:
            break
        parts.append(m.group()[:need - n])
        n += len(parts[-1])
        ends.append((n, at + len(parts[-1])))
        m = BREAK.match(text, m.end())
        if m is None and n < need:
            break
        at = m.end() if m else at
    return "".join(parts), ends


def decoded(chars: str) -> bytes:
    """Bytes of base64 in one of the alphabets, and none of a mixture of them."""
    if ("+" in chars or "/" in chars) and ("-" in chars or "_" in chars):
        return b""
    usable = len(chars) - (len(chars) % 4 == 1)
    return base64.b64decode(chars[:usable].translate(URL_ALPHABET) + "=" * (-usable % 4))


def fields_fit(data: bytes) -> bool:
    """Whether the elements whose headers are in `data`, the beginning of a DER sequence, can be those of a private key."""
    top = header(data, 0, 1 << 40)
    at, tags = top[1], []
    while at < top[2] and at + 6 <= len(data):
        x = header(data, at, top[2])
        if x is None:
            return False
        tags.append(x[0])
        if len(tags) == 2 and tags not in ([SEQUENCE, OCTETS], [INTEGER, INTEGER], [INTEGER, SEQUENCE], [INTEGER, OCTETS]):
            return False
        if tags[:2] == [INTEGER, INTEGER] and len(tags) <= 6 and tags[-1] != INTEGER or tags[:2] == [INTEGER, SEQUENCE] and len(tags) == 3 and tags[2] != OCTETS:
            return False
        at = x[2]
    return True


def whole_der(text: str, head: re.Match) -> tuple[str, list[tuple[int, int]], bytes]:
    """Characters, line ends and bytes of the DER that begins at `head`, as long as it promises; no bytes where
    the text is shorter or a field seen on the way is none of a key's. What is read grows by a factor, so a wrong head costs little."""
    nothing: tuple = "", [], b""
    length = promised(decoded(head.group()[:28].translate(URL_ALPHABET)))
    need = 0 if length is None else -(-length * 8 // 6)
    if not 0 < need <= len(text) - head.start():
        return nothing
    have = FIRST
    while have < need:
        chars, _ = gather(text, head.start(), have)
        data = decoded(chars)
        if len(chars) < have or not data or not fields_fit(data):
            return nothing
        have *= GROW
    chars, ends = gather(text, head.start(), need)
    return nothing if len(chars) < need else (chars, ends, decoded(chars))


def whole_openssh(text: str, start: int) -> tuple[str, list[tuple[int, int]], bytes]:
    """The same for an OpenSSH key, whose lengths stand before each field."""
    have = FIRST
    while True:
        chars, ends = gather(text, start, have)
        data = decoded(chars)
        reach = openssh_reach(data)
        if reach is None or reach <= len(data):
            return ("", [], b"") if reach is None else (chars, ends, data)
        need = -(-reach * 8 // 6)
        if len(chars) < have or need > len(text) - start:
            return "", [], b""
        have = max(have * GROW, need + -need % 4)


def keys(text: str, head: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Confirmed keys in base64; the search goes on after a key's end, or after the head of what is none."""
    at, kind = 0, "der" if head is DER else "openssh"
    while (m := head.search(text, at)) is not None:
        at = m.end()
        chars, ends, data = whole_der(text, m) if kind == "der" else whole_openssh(text, m.start())
        n = data and (key_length(data) if kind == "der" else openssh_length(data))
        if not n:
            continue
        n = -(-n * 8 // 6)                                               # the key's own length tells where it ends
        at = next(end - (k - n) for k, end in ends if k >= n)
        while at < len(text) and text[at] == "=":
            at += 1
        yield kind, m.start(), at


def structures(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed structures: (kind, start, end)."""
    files = list(keys(text, OPENSSH))
    yield from files
    for found in keys(text, DER):
        if not any(a <= found[1] < b for _, a, b in files):
            yield found
    for m in HEX_DER.finditer(text):
        n = key_length(bytes.fromhex(m.group()))
        if n is not None:
            yield "der", m.start(), m.start() + 2 * n
    for m in JWT.finditer(text):
        if signed_token(m.group()):
            yield "jwt", m.start(), m.end()


def signed_token(token: str) -> bool:
    head, body, signature = token.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return bool(signature) or head["alg"].lower() == "none"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text in order."""
    low, out = text.lower(), []
    if any(name in low for name in ASSIGN_NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    out += structures(text)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch, "text"):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every row of `docs`."""
    python_ready(docs.sparkSession)
    rows = keyed_text(docs, key, text)
    return rows.mapInArrow(_scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
