r"""Main text of pages by union-free wrapper inference.

*Token streams.* A page becomes a stream of block tags and texts: inline tags
belong to the text around them, implied end tags are filled in, and an element is
named by its tag, classes, id and role (digits as ``0``).

*Inference.* In each element of a stream, adjacent repeats fold into groups,
innermost first. The distinct folded streams of a host, with no more than a row
per stream and task before the shuffle, are then aligned one after another with
the wrapper so far: what matches stays, a mismatch becomes an optional part, an
occurrence of a group's body joins the group, and texts are slots. The result has
no alternatives, so its size follows the template and not the number of pages;
partial wrappers (of part of a host's streams) align the same way, so a hot host
is spread over `salts` tasks first.

*Extraction.* Slots of the wrapper are main text or not by where they stand:
those inside menus, page headers, footers, sidebars, notices, adverts, forms and
comments are not (what class names alone or a form mark counts all the same where it
holds most of the page, a main region, or an article longer than all else); on a page
with text in an article or main region, only slots in it are; on the others, slots in
repeated groups of nothing but links are not, nor slots with one and the same text on
all of the host's pages without such a region, three or more of them different outside
of chrome; a page with nothing else keeps these. A page's
texts in main slots are its blocks: character references decoded, white space
made one space, joined by ``\n`` in page order.

Every page counts for its host's wrapper; there is no sample. A null page is
empty; a null url is a host of its own. A page cut off within a tag loses that tag.
Repeated rows and null ids pass through; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import html as markup
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import python_ready, stored
from quarry.llm.words import slices

SALTS = 8
DEPTH = 150                  # elements nested deeper count as part of the one at this depth
CONSTANT_PAGES = 3
LAYOUT_SLOTS = 3             # slots that make an element more than one notice
MAX_PERIOD = 12              # elements of a group's body
#: of these, neighbours are repeats whatever they hold; of others, only equal ones are
ALIKE = frozenset("p li dt dd tr option blockquote h1 h2 h3 h4 h5 h6".split())
RAW = ["script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "xmp"]
# an element's end is searched no further than the next start of the same element
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(" + "|".join(RAW) + r")\b[^>]*>(?:.*?</\1\s*>|.*)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[a-zA-Z/!?][^>]*\Z|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp
 small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
#: an open element of this kind ends where one of these begins
ENDS = {"p": frozenset("""address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main
 nav ol p pre section table ul""".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
        "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select fieldset head title object canvas audio video".split())
WEAK_TAGS = frozenset(["form", "fieldset"])
CHROME_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CHROME_NAMES = re.compile(
    r"(?:^|[-_])(?:ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|gdpr"
    r"|notice|popup|modal|overlay|newsletter|subscribe|signup|comments?|commentlist|disqus|replies|respond|related|recommended|share|sharing|social"
    r"|toolbar|pagination|pager|widget|login|search|skip)(?:$|[-_])")
#: reader comments, however much of a page they are
COMMENT_NAMES = re.compile(r"(?:^|[-_])(?:comments?|commentlist|disqus|replies|respond)(?:$|[-_])")
#: classes that tell the state of an element and not what it is
STATE_NAMES = re.compile(r"^(?:no|has|with|without)[-_]|[-_](?:open|closed|enabled|disabled|layout)$")
WEAK, STRONG = 1, 2
HEADER_NAMES = re.compile(r"(?:^|[-_])(?:header|masthead|topbar)(?:$|[-_])")
SPACE = re.compile(r"\s+")


def element(tag: str, attributes: str) -> str:
    """Name of an element: tag, classes and id, role, and whether it is hidden."""
    if not attributes.strip():
        return tag
    names, flags = [], ""
    for m in ATTRIBUTE.finditer(attributes):
        what, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if what in ("class", "id"):
            names += re.sub(r"[0-9]+", "0", value).replace("/", "_").split()
        elif what == "role":
            flags += "@" + re.sub(r"[^a-z]", "", value)
        elif what == "hidden" or what == "aria-hidden" and value == "true" or what == "style" and re.search(r"display\s*:\s*none", value):
            flags += "@hidden"
    return tag + "".join("." + n for n in sorted(set(names))) + flags


def blocks(html: str) -> Iterator[tuple[str, str]]:
    """("<", element), (">", ""), and ("T", text) for each block's text, with implied ends."""
    stack: list[str] = []
    text: list[str] = []
    links = [0, 0]                                     # open <a>; characters outside of them

    def flush() -> Iterator[tuple[str, str]]:
        if text:
            out = SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if out:
                yield ("L" if not links[1] else "T"), out
            links[1] = 0
    for m in TOKEN.finditer(html):
        s = m.group()
        if s[0] != "<" or s == "<":
            s = markup.unescape(s)
            text.append(s)
            if not links[0] and not s.isspace():
                links[1] += len(s)
            continue
        tag = m.group(3) or m.group(6)
        if not tag:
            continue                                   # comment, declaration, script, or a tag cut off
        tag, closing = tag.lower(), m.group(2) or m.group(5)
        if tag in INLINE:
            if tag == "a":
                links[0] = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        yield from flush()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == tag), None)
            if at is not None:
                yield from [(">", "")] * (min(len(stack), DEPTH) - min(at, DEPTH))
                del stack[at:]
            continue
        if tag in VOID:
            continue
        while stack and tag in ENDS.get(stack[-1], ()):
            stack.pop()
            if len(stack) < DEPTH:
                yield ">", ""
        stack.append(tag)
        if len(stack) <= DEPTH:
            yield "<", element(tag, m.group(4) or m.group(7) or "")
    yield from flush()
    yield from [(">", "")] * min(len(stack), DEPTH)


# --- wrappers: lists of [item, required]; an item is a text slot "T" ("L": links only), an element
# --- [name, wrapper] or a repeated group ["+", wrapper]

def label(item) -> str:
    """What two items must share to be repeats of each other."""
    if isinstance(item, str):
        return "T"
    name, inner = item
    if name == "+":
        return "+" + ",".join(label(x) for x, _ in inner)
    return name if name.split(".")[0].split("@")[0] in ALIKE else json.dumps(item)


def fold(items: list) -> list:
    """Adjacent repeats made into groups, shortest bodies first."""
    period = 1
    while period <= min(MAX_PERIOD, len(items) // 2):
        labels, out, i = [label(x) for x, _ in items], [], 0
        while i < len(items):
            n = 1
            while i + (n + 1) * period <= len(items) and labels[i + n * period:i + (n + 1) * period] == labels[i:i + period]:
                n += 1
            if n == 1:
                out.append(items[i])
                i += 1
                continue
            body = items[i:i + period]
            for k in range(1, n):
                body = align(body, items[i + k * period:i + (k + 1) * period])
            one = body[0][0] if period == 1 else None
            out.append([one if isinstance(one, str) or one and one[0] == "+" else ["+", body], True])
            i += n * period
        period = period + 1 if len(out) == len(items) else 1          # shorter repeats may have come about
        items = out
    return items


def wrapper_of(stream: Iterator[tuple[str, str]]) -> list:
    """The wrapper of one page."""
    open_: list[tuple[str, list]] = [("", [])]
    for kind, x in stream:
        if kind == "<":
            open_.append((x, []))
        elif kind == ">":
            name, inner = open_.pop()
            open_[-1][1].append([[name, fold(inner)], True])
        else:
            open_[-1][1].append([kind, True])
    return fold(open_[0][1])


def _like(a, b) -> bool:
    """Whether two items can be one: text slots, elements of one name, groups whose bodies begin alike."""
    if isinstance(a, str) or isinstance(b, str):
        return isinstance(a, str) and isinstance(b, str)
    if a[0] == b[0] == "+":
        return _like(a[1][0][0], b[1][0][0])
    return a[0] == b[0]


def _merge(a, b):
    if isinstance(a, str):
        return a if a == b else "T"
    return [a[0], align(a[1], b[1])]


def _gather(items: list, others: list) -> list:
    """Occurrences in `items` of the bodies of groups among `others` join as groups."""
    for other, _ in others:
        if isinstance(other, str) or other[0] != "+":
            continue
        body = [x for x, _ in other[1]]
        out, i = [], 0
        while i < len(items):
            part = [x for x, _ in items[i:i + len(body)]]
            if len(part) == len(body) and all((isinstance(x, str) or x[0] != "+") and _like(x, y) for x, y in zip(part, body)):
                group = ["+", items[i:i + len(body)]]
                last = out[-1][0] if out else ""
                if not isinstance(last, str) and last[0] == "+" and _like(last, group):
                    out[-1] = [_merge(last, group), out[-1][1]]
                else:
                    out.append([group, True])
                i += len(body)
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """The union-free wrapper of two: a longest common subsequence, with the rest optional."""
    if a == b:
        return a
    a, b = _gather(a, b), _gather(b, a)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if _like(a[i][0], b[j][0]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if _like(a[i][0], b[j][0]):
            out.append([_merge(a[i][0], b[j][0]), a[i][1] and b[j][1]])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], False])
            i += 1
        else:
            out.append([b[j][0], False])
            j += 1
    return out + [[x, False] for x, _ in a[i:]] + [[x, False] for x, _ in b[j:]]


@lru_cache(1 << 16)
def chrome(name: str, in_main: bool) -> int:
    """Whether an element of this name holds something other than the article: 0, STRONG, or WEAK where that
    is a guess by class names or a form, which the text below it can refute (see `chosen`)."""
    head, *roles = name.split("@")
    tag, *names = head.split(".")
    names = [n for n in names if not STATE_NAMES.search(n)]
    if tag in ("html", "body"):
        return 0
    if tag in CHROME_TAGS - WEAK_TAGS or any(r in CHROME_ROLES - WEAK_TAGS or r == "hidden" for r in roles) \
            or not in_main and (tag == "header" or "banner" in roles):
        return STRONG
    if tag == "main" or "main" in roles:
        return 0
    if any(COMMENT_NAMES.search(n) for n in names):
        return STRONG
    if tag in WEAK_TAGS or "form" in roles or any(CHROME_NAMES.search(n) for n in names) \
            or not in_main and any(HEADER_NAMES.search(n) for n in names):
        return WEAK
    return 0


def is_main(name: str) -> bool:
    return name.split("@")[0].split(".")[0] in ("article", "main") or name.endswith("@main")


def only_links(items: list) -> bool:
    """Whether all text slots are links, and there is one."""
    kinds = [x if isinstance(x, str) else "L" if only_links(x[1]) else "T" for x, _ in items if isinstance(x, str) or has_text(x[1])]
    return bool(kinds) and all(k == "L" for k in kinds)


def has_text(items: list) -> bool:
    return any(isinstance(x, str) or has_text(x[1]) for x, _ in items)


def slots(wrapper: list) -> list[tuple[str, bool]]:
    """(path, in a group of links) of each text slot."""
    out = []

    def walk(items: list, path: str, links: bool) -> None:
        for x, _ in items:
            if isinstance(x, str):
                out.append((path, links))
            elif x[0] == "+":
                walk(x[1], path, links or only_links(x[1]))
            else:
                walk(x[1], f"{path}/{x[0]}", links)
    walk(wrapper, "", False)
    return out


def dull_paths(wrapper: list, constant: set[str]) -> list[str]:
    """Paths of slots that are not main text on pages without a region: "L" and the path for links, "C" for constant ones."""
    found = slots(wrapper)
    links = {p for p, x in found if x} - {p for p, x in found if not x}
    return sorted(["L" + p for p in links] + ["C" + p for p in constant])


def standing(found: list[tuple[str, str]]) -> Iterator[tuple[str, str, bool, tuple[str, ...]]]:
    """(path, text, in an article or main region, paths of the weak chrome it is in) of a page's texts outside
    of chrome. Weak chrome within a region is chrome; a main element is none whatever weak chrome it is in."""
    stack = [("", False, False, ())]
    for kind, x in found:
        if kind == "<":
            path, inside, bad, weak = stack[-1]
            path, level = f"{path}/{x}", chrome(x, inside)
            if level == WEAK and not inside:
                weak = (*weak, path)
            elif level:
                bad = True
            if not inside and is_main(x):
                inside = True
                if not x.startswith("article"):
                    weak = ()
            stack.append((path, inside, bad, weak))
        elif kind == ">":
            stack.pop()
        elif not stack[-1][2]:
            yield stack[-1][0], x, stack[-1][1], stack[-1][3]


def layout(texts: list[tuple[str, str, bool, tuple[str, ...]]]) -> set[str]:
    """Paths of the weak chrome that holds most of a page: most of its slots (LAYOUT_SLOTS or more), and
    more than three quarters of its characters."""
    slots_of: dict[str, set[str]] = {}
    chars: dict[str, int] = {}
    for path, x, _, weak in texts:
        for at in weak:
            slots_of.setdefault(at, set()).add(path)
            chars[at] = chars.get(at, 0) + len(x)
    if not chars:
        return set()
    n_slots, n_chars = len({t[0] for t in texts}), sum(len(t[1]) for t in texts)
    return {at for at, own in slots_of.items() if len(own) >= LAYOUT_SLOTS and 2 * len(own) > n_slots and 4 * chars[at] > 3 * n_chars}


def chosen(found: list[tuple[str, str]]) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the page has text in a region, and (path, text) of the texts there, or else of all outside of chrome.

    Weak chrome that is layout does not count; nor does that of an article where all other text is less."""
    texts = list(standing(found))
    refuted = layout(texts)
    clear = [(p, x, region) for p, x, region, weak in texts if refuted.issuperset(weak)]
    inside, others = [(p, x) for p, x, region in clear if region], [(p, x) for p, x, _ in clear]
    if not inside:
        marked = [(p, x) for p, x, region, _ in texts if region]
        if sum(len(x) for _, x in marked) > sum(len(x) for _, x in others):
            inside = marked
    return bool(inside), inside or others


# --- Spark ------------------------------------------------------------------------------------------

STREAMS = "host string, wrapper string, path string, low bigint, high bigint, pages bigint"


def _text_hash(s: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct folded streams by host; of pages without a region, the smallest and largest text hash by host
    and path, the number by host, and as many digests by host and task as tell whether CONSTANT_PAGES differ."""
    seen: set[tuple[str, str]] = set()
    digests: dict[str, set[int]] = {}
    for batch in batches:
        texts: dict[tuple[str, str], list[int]] = {}
        new: set[tuple[str, str]] = set()
        counts: dict[str, int] = {}
        rows: list[tuple] = []
        for part in slices(batch, "html"):
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                found, own = list(blocks(html)), {}
                has_main, kept = chosen(found)
                for path, x in kept if not has_main else ():
                    own[path] = _text_hash(f"{own.get(path, 0)} {x}")
                key = host, json.dumps(wrapper_of(found), separators=(",", ":"))
                if key not in seen:
                    new.add(key)
                if not has_main:                        # constants matter only where no region tells the article
                    for path, h in own.items():
                        t = texts.setdefault((host, path), [h, h, 0])
                        t[:] = min(t[0], h), max(t[1], h), t[2] + 1
                    counts[host] = counts.get(host, 0) + 1
                    known, digest = digests.setdefault(host, set()), _text_hash(json.dumps(kept))
                    if len(known) < CONSTANT_PAGES and digest not in known:
                        known.add(digest)
                        rows.append((host, None, None, digest, None, 0))
        seen |= new
        rows += [(h, w, None, None, None, None) for h, w in new] + [(h, None, p, *t) for (h, p), t in texts.items()]
        rows += [(h, None, None, None, None, n) for h, n in counts.items()]
        if rows:
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                                             ["host", "wrapper", "path", "low", "high", "pages"])


def _align_all(t: pa.Table) -> pa.Table:
    wrapper = None
    for w in sorted(t.column("wrapper").to_pylist(), key=lambda w: (len(w), w)):
        wrapper = json.loads(w) if wrapper is None else align(wrapper, json.loads(w))
    return pa.table({"host": t.column("host")[:1], "wrapper": [json.dumps(wrapper, separators=(",", ":"))]})


def infer_wrappers(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, wrapper, paths) from (host, html): the wrapper as JSON and a line for each path of `dull_paths`."""
    found = stored(pages.select("host", "html").mapInArrow(_streams, STREAMS), "streams")
    distinct = found.filter("wrapper IS NOT NULL").select("host", "wrapper").distinct()
    part = distinct.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    some = part.groupBy("host", "salt").applyInArrow(_align_all, "host string, wrapper string")
    whole = some.groupBy("host").applyInArrow(_align_all, "host string, wrapper string")
    pages_of = (found.filter("wrapper IS NULL AND path IS NULL").groupBy("host")
                .agg(F.sum("pages").alias("all_pages"), F.size(F.collect_set("low")).alias("different"))
                .filter(F.col("different") >= CONSTANT_PAGES))
    constant = (found.filter("path IS NOT NULL").groupBy("host", "path")
                .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pages").alias("pages"))
                .filter("low = high").join(pages_of, "host").filter("pages = all_pages")
                .groupBy("host").agg(F.collect_set("path").alias("constant")))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [dull_paths(json.loads(w), set(c or ())) for w, c in
                     zip(b.column("wrapper").to_pylist(), b.column("constant").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("wrapper"), pa.array(["\n".join(p) for p in paths], pa.string())],
                                             ["host", "wrapper", "paths"])
    return stored(whole.join(constant, "host", "left").mapInArrow(choose, "host string, wrapper string, paths string"), "wrappers")


def main_text(html: str, dull: frozenset[str]) -> str:
    """The page's blocks in main slots, joined."""
    has_main, texts = chosen(list(blocks(html)))
    if not has_main:
        texts = [(p, x) for p, x in texts if "L" + p not in dull]
        texts = [(p, x) for p, x in texts if "C" + p not in dull] or texts
    return "\n".join(x for _, x in texts)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset[str]] = {}
    for batch in batches:
        for part in slices(batch, "html"):
            out = []
            for html, paths in zip(part.column("html").to_pylist(), part.column("paths").to_pylist()):
                if paths not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[paths] = frozenset(paths.split("\n"))
                out.append(main_text(html, known[paths]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())],
                                             ["page_id", "url", "text"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    python_ready(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host.alias("host"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    wrappers = infer_wrappers(rows).select("host", "paths")
    got = rows.join(wrappers, "host", "left").select("page_id", "url", "html", F.coalesce("paths", F.lit("")).alias("paths"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return got.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
