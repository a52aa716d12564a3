"""N-gram Jaccard join: prefix-tree join over globally ordered shingle sets.

A text's set holds the hashes of its distinct five-word shingles (A-Z as a-z);
a text of one to four words has its whole sequence as the only shingle, a null
or empty text has none and links with nothing. Two sets link when
``intersection >= 0.75 * union``; the result labels each document with the
smallest doc_id that it reaches by links.

1. *Shared shingles.* Only shingles found in two different sets can count for
   an intersection. Every map task packs its sets' hashes into one binary
   column per hash bucket; a bucket's reducer sorts them and sends back the
   shared ones. Equal sets, and equal shingles of the sets flushed together, go
   out once, so a hot text or passage costs an entry per flush, not per row. A
   set with under 3/4 of its shingles shared is finished: it has no partner.
2. *Prefixes.* The rest are ordered rarest shingle first (ties by hash). Two
   linked sets share one of their first ``shared - ceil(0.75 n) + 1``
   shingles; sets that do so, directly or through others, form a block.
3. *Prefix tree.* In each block the sets are stored in a radix tree; a probing
   set walks it with the overlap so far, which all sets below a node share,
   and leaves subtrees whose remaining length cannot reach the threshold or
   whose sets are already in its component.

Blocks of more than `block_sets` sets are dealt out in shards. Each shard also
gets the block's pivots; afterwards only sets that their shard does not link to the
main pivot are probed against all shards, so that a huge group of near
copies costs one pass while no link is lost.

Nulls in doc_id give a row with a null id whose links count as any other's;
rows that repeat (id, text) are equal sets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import components
from quarry.llm.store import carried, keyed_text, put_back, python_ready, stored
from quarry.llm.words import WHITE_SPACE, find_words, hash_windows, hash_words, mix, one_hash, slices, text_buffer

WORDS = 5
FLUSH_TOKENS = 500_000        # shingles packed together by a map task
FLUSH_SETS = 60_000           # they are numbered by 16 bits
BLOCK_SETS = 1_000            # sets of a block handled by one task
BLOCK_TOKENS = 2_000_000      # shingles of a block handled by one task
PIVOTS = 4


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    buf, off = text_buffer(batch.column("text"))
    starts, ends, rows = find_words(buf, off, WHITE_SPACE)
    words = hash_words(buf, starts, ends)
    windows = hash_windows(words, WORDS)
    for r in range(len(rows) - 1):
        a, b = rows[r], rows[r + 1]
        if b - a >= WORDS:
            s = np.sort(windows[a:b - WORDS + 1])
            yield r, s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield r, np.array([one_hash(words[a:b])], np.uint64)
        else:
            yield r, np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    one = mix(s).sum(dtype=np.uint64)
    two = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return np.array([one, two], ">u8").tobytes()


# --- packed entries: sets (id, size, entries) and their shingles -----------------------------------

def pack(ids: np.ndarray, sizes: np.ndarray, refs: np.ndarray, tokens: np.ndarray) -> bytes:
    used, local = np.unique(refs, return_inverse=True)
    head = np.array([len(used), len(tokens)], np.int64)
    return b"".join([head.tobytes(), ids[used].tobytes(), sizes[used].astype(np.int32).tobytes(),
                     local.astype(np.uint16).tobytes(), planes(tokens)])


def planes(tokens: np.ndarray) -> bytes:
    """The tokens' bytes, all first ones first: of sorted tokens the high bytes compress away."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


def unpack(payloads) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, sizes, refs, tokens, base = [], [], [], [], 0
    for p in payloads:
        n, m = np.frombuffer(p, np.int64, 2)
        at = 16
        ids.append(np.frombuffer(p, "V16", n, at))
        sizes.append(np.frombuffer(p, np.int32, n, at := at + 16 * n))
        refs.append(np.frombuffer(p, np.uint16, m, at := at + 4 * n).astype(np.int32) + np.int32(base))
        tokens.append(from_planes(np.frombuffer(p, np.uint8, 8 * m, at + 2 * m)))
        base += n
    return np.concatenate(ids), np.concatenate(sizes), np.concatenate(refs), np.concatenate(tokens)


def payloads_of(t: pa.Table) -> Iterator[pa.Buffer]:
    """The packed rows of a group, without a copy."""
    return (x.as_buffer() for c in t.column("payload").chunks for x in c)


def bucket_rows(first: int, ids, sizes, refs, tokens, at: np.ndarray) -> list[tuple[int, bytes]]:
    """One packed row for each value of `at` (the bucket of each entry)."""
    order = np.argsort(at, kind="stable")
    refs, tokens, at = refs[order], tokens[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(at)]):
        for c in range(a, b, 1 << 16):                 # so that 16 bits number the sets
            d = min(b, c + (1 << 16))
            out.append((first + int(at[a]), pack(ids, sizes, refs[c:d], tokens[c:d])))
    return out


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids.view(">u8").reshape(-1, 2)[:, 0].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)


def token_bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def groups(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, start of each group of equal tokens, and the groups' sizes."""
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    cuts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    return order, cuts, np.diff(np.append(cuts, len(t)))


PACKED = "bucket int, payload binary"
NOBODY = np.zeros(1, "V16")          # stands for the sets of one flush that share a shingle


def pack_shingles(buckets: int):
    """Map side: token buckets are 0 .. buckets - 1, set buckets follow."""

    def flush(sets: dict[bytes, np.ndarray]) -> list[tuple[int, bytes]]:
        ids = np.concatenate([np.frombuffer(b"".join(sets), "V16"), NOBODY])
        lens = np.array([len(s) for s in sets.values()])
        sizes = np.append(lens, 0)
        tokens, refs = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), lens)
        order, cuts, counts = groups(tokens)
        tokens, refs = tokens[order], refs[order]
        many = np.repeat(counts > 1, counts)
        # shared within this flush: known already; one entry tells the others
        home = bucket_rows(buckets, ids, sizes, refs[many], tokens[many], id_bucket(ids, buckets)[refs[many]])
        out_t, out_r = tokens[cuts], np.where(counts > 1, len(sets), refs[cuts])
        return home + bucket_rows(0, ids, sizes, out_r, out_t, token_bucket(out_t, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, held = set(), {}, 0
        for batch in batches:
            for part in slices(batch, "text"):
                for _, s in shingle_sets(part):
                    if len(s) and (k := set_id(s)) not in seen:
                        seen.add(k)
                        sets[k] = s
                        held += len(s)
                    if held >= FLUSH_TOKENS or len(sets) >= FLUSH_SETS:
                        yield rows_batch(flush(sets))
                        sets, held = {}, 0
        if sets:
            yield rows_batch(flush(sets))
    return run


def rows_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                      ["bucket", "payload"])


def mark_shared(buckets: int):
    """Token buckets answer with the entries whose shingle two sets have; set buckets pass."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("bucket")[0].as_py() >= buckets:
            return t.select(["bucket", "payload"])
        ids, sizes, refs, tokens = unpack(payloads_of(t))
        order, _, counts = groups(tokens)
        shared = order[np.repeat(counts > 1, counts)]
        shared = shared[ids[refs[shared]] != NOBODY[0]]
        rows = bucket_rows(buckets, ids, sizes, refs[shared], tokens[shared], id_bucket(ids, buckets)[refs[shared]])
        return pa.Table.from_batches([rows_batch(rows)])
    return run


def threshold(n):
    """Shingles that a set of n must share with any partner: ceil(0.75 n)."""
    return -(-3 * n // 4)


def gather_sets(t: pa.Table) -> pa.Table:
    """Shared shingles of each set that has enough of them."""
    ids, sizes, refs, tokens = unpack(payloads_of(t))
    names, where = np.unique(ids.view(">u8").reshape(-1, 2), axis=0, return_inverse=True)
    where = where.reshape(-1)
    size = np.zeros(len(names), np.int64)
    size[where] = sizes
    owner = where[refs]
    order = np.lexsort((tokens, owner))
    owner, tokens = owner[order], tokens[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])]) if len(owner) else np.empty(0, bool)
    owner, tokens = owner[new], tokens[new]
    counts = np.bincount(owner, minlength=len(names))
    keep = counts >= threshold(size)
    tokens = tokens[keep[owner]]
    offsets = np.concatenate([[0], np.cumsum(counts[keep])]).astype(np.int32)
    return pa.table({
        "cls": pa.array([x.tobytes() for x in names[keep]], pa.binary()),
        "n": pa.array(size[keep], pa.int64()),
        "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64), pa.int64()))})


def shared_sets(texts: DataFrame, buckets: int) -> DataFrame:
    """(cls, n, tokens): the sets with at least ceil(0.75 n) shared shingles, and those."""
    packed = texts.select("text").mapInArrow(pack_shingles(buckets), PACKED)
    marked = packed.groupBy("bucket").applyInArrow(mark_shared(buckets), PACKED)
    return marked.groupBy("bucket").applyInArrow(gather_sets, "cls binary, n bigint, tokens array<bigint>")


# --- blocks ----------------------------------------------------------------------------------------

def ordered_sets(sets: DataFrame) -> DataFrame:
    """Shingles rarest first (ties by hash) with the length of the probing prefix.

    `sets` is a stored table whose `id` names a set in one number."""
    flat = sets.select("id", F.explode("tokens").alias("tok"))
    df = flat.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    got = flat.join(df, "tok").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("s"))
    named = got.select("id", F.col("s.tok").alias("tokens")).join(sets.select("id", "cls", "n"), "id")
    prefix = F.size("tokens") - F.ceil(F.col("n") * 0.75) + 1
    return named.select("cls", "n", "tokens", prefix.cast("int").alias("prefix")).filter("prefix > 0")


def prefix_edges(sets: DataFrame, salts: int = 16) -> DataFrame:
    """(a, b), repeated: each set with a leader of every prefix shingle's sets, leaders with one of theirs.

    Leaders are first chosen in `salts` parts of a shingle's sets, so that a
    shingle of very many sets is spread over as many tasks.
    """
    rows = sets.select("cls", F.explode(F.expr("slice(tokens, 1, prefix)")).alias("tok")) \
        .withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(salts)))
    local = rows.groupBy("tok", "salt").agg(F.min("cls").alias("lead"))
    top = local.groupBy("tok").agg(F.min("lead").alias("b"))
    return (rows.join(local, ["tok", "salt"]).select(F.col("cls").alias("a"), F.col("lead").alias("b"))
            .unionByName(local.join(top, "tok").select(F.col("lead").alias("a"), "b")))


class Node:
    __slots__ = ("end", "kids", "least", "own", "part", "rest", "seg")


class PrefixTree:
    """Radix tree over sets given as sorted arrays of ranks.

    A node has the ranks on its edge, the sets that end there, the smallest set
    size and the most ranks still to come below, and, once known, a set that
    stands for all below because they are in one component.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, members: list[int]):
        order = sorted(members, key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.sizes = sets, sizes
        self.root = self._node(order, 0)

    def _node(self, order: list[int], depth: int) -> Node:
        sets = self.sets
        a, b = sets[order[0]], sets[order[-1]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        x = Node()
        x.seg, x.end = a[depth:end], int(a[end - 1]) if end else -1
        x.least = min(int(self.sizes[i]) for i in order)
        x.rest = max(len(sets[i]) for i in order) - end
        x.own = [i for i in order if len(sets[i]) == end]
        x.kids = []
        x.part = order[0] if len(order) == 1 else None
        k = len(x.own)
        while k < len(order):
            t, j = sets[order[k]][end], k + 1
            while j < len(order) and sets[order[j]][end] == t:
                j += 1
            x.kids.append(self._node(order[k:j], end))
            k = j
        return x


class Parts:
    """Union-find of the sets of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_sets(sets: list[np.ndarray], sizes: np.ndarray, parts: Parts, members: list[int], probes: list[int]) -> None:
    """Join the parts of any two linked sets, one a member of the tree and one a probe."""
    used, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    frequent = np.argsort(-np.bincount(ranks, minlength=len(used)), kind="stable")   # long shared paths
    place = np.empty(len(used), np.uint32)
    place[frequent] = np.arange(len(used), dtype=np.uint32)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    sets = [np.sort(s) for s in np.split(place[ranks], cuts)]
    tree = PrefixTree(sets, sizes, members)
    has = np.zeros(len(used), bool)
    find = parts.find

    def walk(node: Node, x: int, mine: np.ndarray, size: int, overlap: int) -> None:
        if node.part is not None and find(node.part) == find(x):
            return
        overlap += int(np.count_nonzero(has[node.seg]))
        left = len(mine) - int(np.searchsorted(mine, node.end, side="right")) if node.end >= 0 else len(mine)
        if 7 * (overlap + min(left, node.rest)) < 3 * (size + node.least):
            return
        for y in node.own:
            if 7 * overlap >= 3 * (size + int(sizes[y])):
                parts.join(x, y)
        for kid in node.kids:
            walk(kid, x, mine, size, overlap)
        if node.part is None and all(k.part is not None for k in node.kids):
            roots = {find(i) for i in node.own} | {find(k.part) for k in node.kids}
            if len(roots) == 1:
                node.part = roots.pop()

    for x in probes:
        has[sets[x]] = True
        walk(tree.root, x, sets[x], int(sizes[x]), 0)
        has[sets[x]] = False


def list_arrays(col: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for c in col.chunks:
        values, off = c.values.to_numpy(), c.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(off[:-1], off[1:])]
    return out


LOCAL = "block binary, shard int, cls binary, n bigint, tokens array<bigint>, home boolean, label binary"


def join_block(t: pa.Table) -> pa.Table:
    """The sets of one shard of a block with the labels of their local components (the smallest name in each)."""
    names, sizes = t.column("cls").to_pylist(), t.column("n").to_numpy()
    order = sorted(range(len(names)), key=names.__getitem__)      # a part's first set has the smallest name
    place = {k: i for i, k in enumerate(order)}
    arrays = list_arrays(t.column("tokens"))
    parts, every = Parts(len(names)), list(range(len(names)))
    with deep():
        link_sets([arrays[i] for i in order], sizes[order], parts, every, every)
    labels = [names[order[parts.find(place[i])]] for i in range(len(names))]
    return t.append_column("label", pa.array(labels, pa.binary()))


def probe_shard(t: pa.Table) -> pa.Table:
    """Links (a, b) between a shard and sets outside the block's largest component."""
    names, sizes = t.column("cls").to_pylist(), t.column("n").to_numpy()
    labels, probing = t.column("label").to_pylist(), t.column("probing").to_pylist()
    parts, first = Parts(len(names)), {}
    for i, x in enumerate(labels):
        parts.join(first.setdefault(x, i), i)
    before = [parts.find(i) for i in range(len(names))]
    members, probes = [i for i, p in enumerate(probing) if not p], [i for i, p in enumerate(probing) if p]
    if members and probes:
        with deep():
            link_sets(list_arrays(t.column("tokens")), sizes, parts, members, probes)
    moved = [i for i in range(len(names)) if before[i] == i and parts.find(i) != i]
    return pa.table({"a": pa.array([labels[i] for i in moved], pa.binary()),
                     "b": pa.array([labels[parts.find(i)] for i in moved], pa.binary())})


class deep:
    """A tree is as deep as its sets are many, at most."""

    def __enter__(self):
        import sys
        self.before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(self.before, 4 * BLOCK_SETS + 20_000))

    def __exit__(self, *_):
        import sys
        sys.setrecursionlimit(self.before)


def join_blocks(sets: DataFrame, blocks: DataFrame, block_sets: int) -> DataFrame:
    """(cls, label): components by links among the sets of each block.

    Each shard of a large block also gets the block's pivots. What a shard links
    to the block's main pivot, the one with most sets, is one component across all
    shards; only the other sets are then probed against every shard."""
    sized = stored(sets.join(blocks.select(F.col("node").alias("cls"), F.col("label").alias("block")), "cls")
                   .select("block", "cls", "n", "tokens"), "blocks")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum(F.size("tokens")) / BLOCK_TOKENS)).cast("int")
    shards = stored(sized.groupBy("block").agg(count.alias("shards")).filter("shards > 1"), "shards")
    cols = ["block", "shard", "cls", "n", "tokens", "home"]
    one = sized.join(shards, "block", "left_anti").withColumns({"shard": F.lit(0), "home": F.lit(True)}).select(*cols) \
        .groupBy("block").applyInArrow(join_block, LOCAL).select("cls", "label")
    if not shards.count():
        return one
    dealt = sized.join(shards, "block").withColumns({
        "shard": F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int"), "home": F.lit(True)})
    pivots = dealt.groupBy("block", "shards", "shard").agg(F.min_by(F.struct("cls", "n", "tokens", "shard"), "cls").alias("p")) \
        .groupBy("block", "shards").agg(F.expr(f"slice(sort_array(collect_list(p)), 1, {PIVOTS})").alias("p")) \
        .select("block", "shards", F.inline("p").alias("cls", "n", "tokens", "own")) \
        .select("block", "cls", "n", "tokens", "own", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard")) \
        .filter("shard != own").withColumn("home", F.lit(False)).select(*cols)
    local = stored(dealt.select(*cols).unionByName(pivots).groupBy("block", "shard").applyInArrow(join_block, LOCAL), "local")

    # a pivot stands in every shard: the sets its label has in all of them
    seen = local.filter("NOT home").select("block", "cls").distinct()
    places = local.select("block", "shard", "cls", "label").join(seen, ["block", "cls"])
    sums = local.filter("home").groupBy("block", "shard", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = places.join(sums, ["block", "shard", "label"], "left").groupBy("block", "cls").agg(F.sum("rows").alias("rows")) \
        .groupBy("block").agg(F.max_by("cls", F.struct("rows", "cls")).alias("cls"))
    mains = stored(places.join(main, ["block", "cls"]).select("block", "shard", "label"), "mains")
    rest = stored(local.filter("home").join(mains, ["block", "shard", "label"], "left_anti").drop("home"), "rest")
    parts = stored(rest.groupBy("block").agg(count.alias("parts")), "parts")
    cut = rest.join(shards, "block").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    cols = ["block", "shard", "part", "cls", "n", "tokens", "label", "probing"]
    probes = cut.drop("shard").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))) \
        .withColumn("probing", F.lit(True)).select(*cols)
    stand = local.filter("home").join(parts, "block").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))) \
        .withColumn("probing", F.lit(False)).select(*cols)
    links = probes.unionByName(stand).groupBy("block", "shard", "part").applyInArrow(probe_shard, "a binary, b binary")
    last = components(links.unionByName(local.select(F.col("cls").alias("a"), F.col("label").alias("b"))))
    multi = local.filter("home").select("cls").join(last.withColumnRenamed("node", "cls"), "cls", "left") \
        .select("cls", F.coalesce("label", "cls").alias("label"))
    return one.unionByName(multi)


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls) of every document."""
    key = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(len(s), set_id(s)) for _, s in shingle_sets(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in got], pa.int64()),
                                                  pa.array([k for _, k in got], pa.binary())], ["doc_id", "n_shingles", "cls"])
    return texts.mapInArrow(run, f"doc_id {key}, n_shingles bigint, cls binary")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    component_id is the smallest doc_id among all documents reachable by links;
    documents without words keep their own.
    """
    spark = docs.sparkSession
    python_ready(spark)
    texts = keyed_text(docs, key, text)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = stored(shared_sets(texts, buckets).withColumn("id", F.monotonically_increasing_id()), "shared")
    sets = stored(ordered_sets(shared), "ordered")
    blocks = components(prefix_edges(sets))
    label = stored(join_blocks(sets, blocks, block_sets), "linked")
    signed = stored(signatures(texts), "signed")
    classes = signed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))
    named = classes.join(label, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = stored(named, "classes")
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    copied = stored(named.join(lowest, "label").select("cls", "component_id"), "named")
    return signed.join(copied, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without those whose component has a document with a smaller id.

    Rows with a null id stay; a repeated row stays as often as its id's row does.
    """
    gone = ngram_components(docs, key, text).filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(carried(docs).alias("row"), F.col(f"`{key}`").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select(*put_back(docs))
