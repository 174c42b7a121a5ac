"""N-gram Jaccard join by signature trees.

Two documents link if the Jaccard similarity of their sets of word shingles is
at least num/den. Equal sets form one class first. For the rest:

* Census. A set of n shingles that links with another shares at least num * n / den of them with it, so
  of its shingles in any fixed order the first n - ceil(num * n / den) + 1 hold one of the other's. The order is
  by the number of sets that hold a shingle, rarest first: those of one set alone come first and are keys of nothing,
  so most sets without a partner have no key at all, and a passage that many documents hold is a key only of
  sets that consist of little else. The numbers are exact counts over all documents: shingles travel in
  compressed chunks of a few bytes each to the task of their hash range, are counted there, and only those held
  twice or more travel back to their chunk (``_chunks``, ``_counted``, ``_keyed``).
* Blocks are the sets with a common key.
* Trees. For a group of sets a tree is built whose nodes hold OR-combined bitmaps and
  size ranges. A traversal of node pairs drops those whose sizes do not match,
  whose bitmaps bound the overlap too low, or whose documents are
  already in one component; what is left is compared shingle by shingle. So a
  group of n near copies costs about n comparisons, not n * n.
* Families. Blocks that share documents form a family, and one tree over the family does the work of
  all its blocks, so a text is read once, not once for each of its keys. A family too large for one tree goes
  block by block: each class meets its largest block (cut into fragments); then one member of each
  component meets those of the others in each block; then all blocks that still hold several
  components are compared in full, fragment pair by fragment pair, where fragments are ranges of size
  and only those near enough to link meet. Nothing is
  sampled: in the end each linked pair has been compared or was connected before.

Cases: null or empty texts have no shingles and link with nothing; with fewer
words than a shingle the whole sequence is one; null ids link with nothing;
rows of one id are one document, which links with what any of its texts links with,
while n_shingles is that of the row's own text; an empty table gives an
empty result; other columns are not read, and pass through ``dedup`` whatever their names.
``docs`` should be a scan of a table: a task that is run again must meet its rows in the same order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import discard, materialize, partitions, sized_broadcast, table

#: Shingles that a fragment of a block may hold, and documents at least.
FRAGMENT_SHINGLES, FRAGMENT_LEAST = 1 << 18, 64
#: Shingles that travel together in the census.
CHUNK_SHINGLES = 1 << 19
FANOUT = 8
#: Size ranges within the ratio of sizes that sets can link at.
SIZE_STEPS = 4
#: Bits of a bitmap for each shingle of the largest set of a block.
BITS = 32

_M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    import xxhash

    # bytes.lower touches A-Z only and bytes.split takes the six ASCII white-space characters
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _M1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; the planes of high bytes are nearly empty."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(raw: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


_CHUNK = ["range", "chunk", "n", "marks", "holders", "counts", "ids", "sizes", "digests"]


def _chunk_schema(key: str) -> str:
    return f"range int, chunk long, n int, marks binary, holders binary, counts binary, ids array<{key}>, sizes array<long>, digests array<binary>"


def _chunk_rows(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(_CHUNK, kinds, strict=True)], names=_CHUNK)


def _chunks(batches, size: int, ranges: int):
    """Of each ``CHUNK_SHINGLES`` shingles of documents: a row with the ids, sizes and digests of the documents, and one for each hash range with its
    shingles' marks (the first 48 bits of their hashes), sorted, and the number in the chunk of each one's document. Copies within a chunk are counted once."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids, sizes, digests, sets, seen, total, id_type = [], [], [], [], set(), 0, None

    def done():
        chunk = task << 32 | number
        yield {"range": chunk % ranges, "chunk": chunk, "ids": ids, "sizes": sizes, "digests": digests}
        if total:
            holder = np.repeat(np.array([i for i, _ in sets], np.uint16), [len(s) for _, s in sets])
            mark = np.concatenate([s for _, s in sets]) >> np.uint64(16)
            order = np.argsort(mark, kind="stable")
            mark, holder = mark[order], holder[order]
            at = ((mark >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)
            ends = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
            for r in np.flatnonzero(np.diff(ends)).tolist():
                a, b = int(ends[r]), int(ends[r + 1])
                yield {"range": r, "chunk": chunk, "n": b - a, "marks": _packed(np.diff(mark[a:b], prepend=np.uint64(0))), "holders": _packed(holder[a:b])}

    for whole in batches:
        id_type = whole.schema.field("doc_id").type
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingle_set(text, size)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and digest not in seen:
                    seen.add(digest)
                    sets.append((len(ids), s))
                    total += len(s)
                ids.append(doc_id)
                sizes.append(len(s))
                digests.append(digest)
                if total >= CHUNK_SHINGLES or len(ids) >= 1 << 15:
                    yield _chunk_rows(list(done()), id_type)
                    number += 1
                    ids, sizes, digests, sets, seen, total = [], [], [], [], set(), 0
    if ids:
        yield _chunk_rows(list(done()), id_type)


def _counted(batches, id_type: pa.DataType):
    """Rows sorted by range: of each chunk the shingles that are held twice or more in all, with that number (255 for more). Rows of documents pass through."""
    rows, now = [], None

    def done():
        marks = [np.cumsum(_unpacked(r["marks"], r["n"], np.uint64)) for r in rows]
        every = np.concatenate(marks)
        order = np.argsort(every, kind="stable")
        sorted_ = every[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        held = np.empty(len(every), np.uint8)
        times = np.diff(np.append(first, len(every)))
        held[order] = np.repeat(np.minimum(times, 255).astype(np.uint8), times)
        at = 0
        for r, mark in zip(rows, marks, strict=True):
            mine = held[at : at + len(mark)]
            at += len(mark)
            some = np.flatnonzero(mine > 1)
            if len(some):
                holder = _unpacked(r["holders"], r["n"], np.uint16)[some]
                yield {"range": r["range"], "chunk": r["chunk"], "n": len(some), "marks": _packed(np.diff(mark[some], prepend=np.uint64(0))), "holders": _packed(holder), "counts": _packed(mine[some])}

    def sliced(found):
        out = []
        for r in found:
            out.append(r)
            if len(out) == 256:
                yield _chunk_rows(out, id_type)
                out = []
        if out:
            yield _chunk_rows(out, id_type)

    for batch in batches:
        for r in batch.to_pylist():
            if r["ids"] is not None:
                yield _chunk_rows([r], id_type)
                continue
            if r["range"] != now:
                if rows:
                    yield from sliced(done())
                rows, now = [], r["range"]
            rows.append(r)
    if rows:
        yield from sliced(done())


def prefix_keys(sizes: np.ndarray, holder: np.ndarray, mark: np.ndarray, held: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of documents with ``sizes`` shingles, of which ``mark`` are those that others may hold: what is left of the prefix after shingles held once."""
    least = -(-num * sizes // den)
    shared = np.bincount(holder, minlength=len(sizes))
    take = np.maximum(shared - least + 1, 0)
    order = np.lexsort((mark, held, holder))
    holder, mark = holder[order], mark[order]
    place = np.arange(len(holder)) - (np.cumsum(shared) - shared)[holder]
    some = place < take[holder]
    return holder[some], _mixed(mark[some] * _M1 + np.uint64(1)).view(np.int64)


def _keyed(batches, num: int, den: int):
    """Rows sorted by chunk: (doc_id, n, digest, keys) of its documents."""
    rows, now = [], None

    def done():
        docs = next(r for r in rows if r["ids"] is not None)
        n = np.array(docs["sizes"], np.int64)
        parts = [(np.cumsum(_unpacked(r["marks"], r["n"], np.uint64)), _unpacked(r["holders"], r["n"], np.uint16), _unpacked(r["counts"], r["n"], np.uint8)) for r in rows if r["ids"] is None]
        mark, holder, held = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, k) for k in (np.uint64, np.uint16, np.uint8))
        owner, key = prefix_keys(n, holder.astype(np.int64), mark, held, num, den)
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))[: len(owner)]
        owner, key = owner[first], key[first]
        # copies within the chunk have the keys of the first
        ends = np.searchsorted(owner, np.arange(len(n) + 1))
        home, of = {}, []
        for i, d in enumerate(docs["digests"]):
            of.append(home.setdefault(d, i))
        lists = [key[ends[i] : ends[i + 1]] for i in of]
        offsets = np.zeros(len(n) + 1, np.int32)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        return docs["ids"], n, docs["digests"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64), pa.int64()))

    for batch in batches:
        kind = batch.schema.field("ids").type.value_type
        for r in batch.to_pylist():
            if r["chunk"] != now:
                if rows:
                    ids, n, digests, keys = done()
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n), pa.array(digests, pa.binary()), keys], names=["doc_id", "n", "digest", "keys"])
                rows, now = [], r["chunk"]
            rows.append(r)
    if rows:
        ids, n, digests, keys = done()
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n), pa.array(digests, pa.binary()), keys], names=["doc_id", "n", "digest", "keys"])


def profiles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, keys): of each document the number of its shingles, the digest of its set, and keys of which every two linked sets that differ share one."""
    key = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    ranges = partitions(docs.sparkSession)
    chunks = docs.select("doc_id", "text").mapInArrow(lambda batches: _chunks(batches, size, ranges), _chunk_schema(key))
    counted = chunks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(lambda batches: _counted(batches, id_type), _chunk_schema(key))
    return counted.repartitionById(ranges, F.pmod("chunk", F.lit(ranges)).cast("int")).sortWithinPartitions("chunk").mapInArrow(lambda batches: _keyed(batches, num, den), f"doc_id {key}, n long, digest binary, keys array<long>")


class SignatureTree:
    """Sets as leaves; each level ORs the bitmaps and joins the size ranges of ``FANOUT`` nodes of the level below."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = np.array([len(s) for s in sets], np.int64)
        width = 1 << max(6, int(BITS * int(n.max()) - 1).bit_length())
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in zip(bits, sets, strict=True):
            at = (s * _M2) >> np.uint64(64 - width.bit_length() + 1)
            np.bitwise_or.at(row, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        # shingles that share a bit with another of their set can hide in it
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, slack = self.levels[-1]
            first = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(slack, first)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether nodes i and j of a level may hold a linked pair."""
        bits, lo, hi, slack = self.levels[level]
        keep = (hi[i] * den >= lo[j] * num) & (hi[j] * den >= lo[i] * num)
        at = np.flatnonzero(keep)
        step = max(1, (1 << 21) // bits.shape[1])
        for a in range(0, len(at), step):
            some = at[a : a + step]
            x, y = i[some], j[some]
            most = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            keep[some] = most * (num + den) >= (lo[x] + lo[y]) * num
        return keep

    def linked(self, i: int, j: int, num: int, den: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return den * both >= num * (len(a) + len(b) - both)


class Groups:
    """Union-find; a root is the smallest label."""

    def __init__(self, labels: np.ndarray):
        known = {}
        self.up = [known.setdefault(x, i) for i, x in enumerate(labels.tolist())]
        self.label = labels.tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.label[j] < self.label[i]:
                i, j = j, i
            self.up[j] = i

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.root, range(len(self.up))), np.int64, len(self.up))


def tree_join(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest label that each set's component reaches. Sets of one label are connected already."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]), int(sets[i][-1])))
    tree, groups = SignatureTree([sets[i] for i in order]), Groups(labels[order])

    def compare(pairs):
        for i, j in pairs:
            if groups.root(i) != groups.root(j) and tree.linked(i, j, num, den):
                groups.join(i, j)

    near = np.arange(len(order) - 1)
    compare((i, i + 1) for i in near[tree.possible(0, near, near + 1, num, den)].tolist())

    def expand(level: int, i: np.ndarray, j: np.ndarray):
        """Node pairs of ``level``, depth first in slices, down to pairs of sets."""
        roots = groups.roots()
        if level == 0:
            apart = (i < j) & (roots[i] != roots[j])
            i, j = i[apart], j[apart]
            keep = tree.possible(0, i, j, num, den)
            compare(zip(i[keep].tolist(), j[keep].tolist(), strict=True))
            return
        size = FANOUT**level
        first = np.arange(0, len(roots), size)
        lo, hi = np.minimum.reduceat(roots, first), np.maximum.reduceat(roots, first)
        apart = ~((lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j]))
        i, j = i[apart], j[apart]
        keep = tree.possible(level, i, j, num, den)
        i, j = i[keep], j[keep]
        below = len(tree.levels[level - 1][0])
        kids = np.arange(FANOUT)
        for a in range(0, len(i), 4096):
            x = (i[a : a + 4096, None, None] * FANOUT + kids[None, :, None]) + 0 * kids[None, None, :]
            y = (j[a : a + 4096, None, None] * FANOUT + kids[None, None, :]) + 0 * kids[None, :, None]
            x, y = x.ravel(), y.ravel()
            real = (x <= y) & (y < below) & (x < below)
            if real.any():
                expand(level - 1, x[real], y[real])

    top = len(tree.levels) - 1
    if len(order) > 1:
        expand(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
    out = np.empty(len(order), np.int64)
    out[order] = [groups.label[r] for r in groups.roots()]
    return out


def _join_blocks(batches, size: int, num: int, den: int):
    """Rows sorted by block: (label, reached) where a component reaches a smaller label."""
    block, sets, labels = None, [], []

    def done():
        old = np.array(labels, np.int64)
        new = tree_join(sets, old, num, den)
        moved = np.unique(np.stack([old, new], axis=1)[old != new], axis=0) if len(old) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(moved[:, 0]), pa.array(moved[:, 1])], names=["a", "b"])

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            for b, part, label, text in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "label", "text")), strict=True):
                if (b, part) != block:
                    if len(sets) > 1:
                        yield done()
                    block, sets, labels = (b, part), [], []
                sets.append(shingle_set(text, size))
                labels.append(label)
    if len(sets) > 1:
        yield done()


def _round(rows: DataFrame, docs: DataFrame, size: int, num: int, den: int, label: str) -> DataFrame:
    """``rows``: (block, part, rep, label). The links that trees over the blocks find: (a, b), b < a."""
    rows = materialize(rows, label)
    texts = docs.join(sized_broadcast(rows), F.col("doc_id") == F.col("rep")).select("block", "part", "label", "text")
    dealt = texts.repartition(partitions(docs.sparkSession), "block", "part").sortWithinPartitions("block", "part")
    links = materialize(dealt.mapInArrow(lambda batches: _join_blocks(batches, size, num, den), "a long, b long").distinct(), label + "-links")
    discard(rows)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``links`` (a, b) reaches. Labels spread along links and jump to their label's label, so the rounds grow with the logarithm of a path's length."""
    both = materialize(links.union(links.select("b", "a")).distinct(), "links")
    state = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.lit(None).cast(both.schema["a"].dataType).alias("was"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        spread = state.join(near, state["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = state.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = materialize(spread.join(jump, spread["label"] == jump["via"], "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        discard(state)
        state = after
        if state.filter("label <> was").isEmpty():
            discard(both)
            return state.select("node", "label")


def _relabel(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with column label moved to what ``links`` connect it with."""
    if links.isEmpty():
        return rows
    found = components(links).select(F.col("node").alias("old"), F.col("label").alias("new"))
    return rows.join(sized_broadcast(found), F.col("label") == F.col("old"), "left").withColumn("label", F.coalesce("new", "label")).drop("old", "new")


def similar(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    found = materialize(profiles(docs, size, num, den), "jaccard-profiles")
    filled = found.filter("n > 0 and doc_id is not null")
    # one document stands for all with its set
    reps = filled.filter(F.size("keys") > 0).groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys")).alias("r")).select(F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.explode("r.keys").alias("key"))
    reps = materialize(reps, "jaccard-keys")
    blocks = materialize(reps.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("low")).filter("m > 1").withColumnRenamed("key", "block"), "jaccard-blocks")
    met = reps.join(sized_broadcast(blocks), F.col("key") == F.col("block")).select("block", "rep", "n", "m", "low")
    # a family is what blocks connect; linked sets are in one family
    # each document is tied to the lowest document it meets, and the lowest of its other blocks to that one: blocks share these, so few edges are left
    lowest = met.groupBy("rep").agg(F.min("low").alias("lowest"), F.collect_set("low").alias("lows"))
    edges = lowest.select("lowest", F.explode(F.array_union(F.array("rep"), F.col("lows"))).alias("a")).filter("a <> lowest").select("a", F.col("lowest").alias("b")).distinct()
    edges = materialize(edges, "jaccard-edges")
    families = components(edges).select(F.col("node").alias("member"), F.col("label").alias("family"))
    sized = families.join(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("member")).agg(F.max("n").alias("n")), "member")
    large = sized.groupBy("family").agg(F.count("*").alias("m"), F.max("n").alias("most")).filter(_fragments(F.col("most"), F.col("m")) > 1).select(F.col("family").alias("split"))
    families = materialize(families.join(F.broadcast(large) if large.count() <= 100_000 else large, F.col("family") == F.col("split"), "left"), "jaccard-families")
    whole = families.filter("split is null").select(F.col("family").alias("block"), F.lit(0).cast("long").alias("part"), F.col("member").alias("rep"), F.col("member").alias("label"))
    links = _round(whole, docs, size, num, den, "jaccard-family")
    split = families.filter("split is not null").select("member")
    if not split.isEmpty():
        rest = materialize(met.join(sized_broadcast(split), F.col("rep") == F.col("member"), "left_semi").select("block", "rep", "n", "m"), "jaccard-split")
        links = links.unionByName(_by_blocks(rest, docs, size, num, den))
        discard(rest)
    discard(reps, blocks, edges, families)
    sets = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "rep")
    sets = materialize(sets, "jaccard-classes")
    known = found.select("doc_id", "n", "digest").join(sized_broadcast(sets), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    return known.join(sized_broadcast(links).withColumnRenamed("a", "rep").withColumnRenamed("b", "component"), "rep", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def _fragments(n, m):
    """How many fragments a block of m sets of about n shingles has."""
    return F.ceil(m / F.greatest(F.lit(FRAGMENT_LEAST), F.floor(F.lit(FRAGMENT_SHINGLES) / n))).cast("long")


def _by_blocks(met: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) within families too large for one tree, by their blocks (block, rep, n, m)."""

    home = met.groupBy("rep").agg(F.max(F.struct("m", "block", "n")).alias("h")).select(F.col("h.block").alias("block"), F.pmod(F.xxhash64("rep"), _fragments(F.col("h.n"), F.col("h.m"))).alias("part"), "rep", F.col("rep").alias("label"))
    links = _round(home, docs, size, num, den, "jaccard-home")
    # each class is in one block, and so in one link at most
    labelled = met.join(sized_broadcast(links), met["rep"] == links["a"], "left").select("block", "rep", "n", F.coalesce("b", "rep").alias("label"))

    def open_blocks(rows):
        """Blocks that hold several components, each set of members once."""
        state = rows.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.max("n").alias("most"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x")).filter("lo <> hi")
        return materialize(state.groupBy("m", "s", "x").agg(F.min("block").alias("block"), F.max("most").alias("most")).select("block", "m", "most"), "jaccard-open")

    labelled = materialize(labelled, "jaccard-labels")
    left = open_blocks(labelled)
    if not left.isEmpty():
        one = labelled.join(sized_broadcast(left), "block").groupBy("block", "label").agg(F.min("rep").alias("rep")).select("block", F.lit(0).cast("long").alias("part"), "rep", "label")
        sizes = one.groupBy("block").agg(F.count("*").alias("k"))
        one = one.join(sizes, "block").join(left.select("block", "most"), "block").select("block", F.pmod(F.xxhash64("rep"), _fragments(F.col("most"), F.col("k"))).alias("part"), "rep", "label")
        found = _round(one, docs, size, num, den, "jaccard-heads")
        labelled = materialize(_relabel(labelled, found), "jaccard-labels")
        links = _chained(links, found)
        left = open_blocks(labelled)
    if not left.isEmpty():
        rows = materialize(_size_pairs(labelled.join(sized_broadcast(left.select("block")), "block").select("block", "rep", "n", "label"), num, den), "jaccard-pairs")
        found = _round(rows, docs, size, num, den, "jaccard-rest")
        discard(rows)
        links = _chained(links, found)
    return links


def _size_range(n, num: int, den: int):
    """Number of a set's size range: sets can only link if theirs differ by ``SIZE_STEPS`` at most. With num = den only equal sizes can."""
    return F.floor(F.log(n.cast("double")) * (SIZE_STEPS / (np.log(den / num) * (1 + 1e-9)))).cast("long") if num < den else n.cast("long") * (SIZE_STEPS + 1)


def _size_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(block, part, rep, label): blocks (block, rep, n, label) cut into fragments by ranges of size, and large ranges by hash; each fragment meets those whose sizes are near enough to link, so a set travels once for each of these and not for every fragment of its block."""
    ranged = materialize(rows.withColumn("range", _size_range(F.col("n"), num, den)), "jaccard-ranges")
    counts = materialize(ranged.groupBy("block", "range").agg(F.count("*").alias("m"), F.max("n").alias("most")).select("block", "range", _fragments(F.col("most"), F.col("m")).alias("f")), "jaccard-fragments")
    mine = sized_broadcast(counts)
    placed = ranged.join(mine, ["block", "range"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("f"))).drop("f")
    other = counts.select("block", F.col("range").alias("near"), F.col("f").alias("g"))
    near = F.explode(F.sequence(F.col("range") - SIZE_STEPS, F.col("range") + SIZE_STEPS))
    met = placed.withColumn("near", near).join(sized_broadcast(other), ["block", "near"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    here, there = F.struct(F.col("range").alias("r"), F.col("i").alias("k")), F.struct(F.col("near").alias("r"), F.col("j").alias("k"))
    # two numbers name a pair of fragments; pairs that share one by chance are compared together, which loses nothing
    part = F.xxhash64(F.least(here, there), F.greatest(here, there))
    lone = counts.join(counts.select("block", F.col("range").alias("near"), F.col("f").alias("g")), "block").filter(F.abs(F.col("range") - F.col("near")) <= SIZE_STEPS)
    lone = lone.groupBy("block", "range").agg((F.sum("g") == 1).alias("lone"))
    # a fragment is compared in itself with each one it meets, and by itself where it meets none
    return met.join(sized_broadcast(materialize(lone, "jaccard-lone")), ["block", "range"]).filter((here != there) | F.col("lone")).select("block", part.alias("part"), "rep", "label")


def _chained(links: DataFrame, more: DataFrame) -> DataFrame:
    """(a, b): every class that is not the smallest of its component, and that smallest one."""
    if more.isEmpty():
        return links
    return materialize(components(links.union(more)).filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), "jaccard-links")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The document with the smallest id of each component stays; documents without shingles or id stay as well."""
    found = similar(docs, **how).filter("doc_id <> component_id").select(F.col("doc_id").alias("__jaccard_gone")).distinct()
    gone = materialize(found, "jaccard-gone")
    return docs.join(sized_broadcast(gone), docs["doc_id"] == gone["__jaccard_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), size=3, num=90)


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, least(t.doc_id, coalesce(y, t.doc_id)) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = t.doc_id
"""
