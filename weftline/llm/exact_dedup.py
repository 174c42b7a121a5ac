"""Exact dedup by Patricia-trie owners.

Texts are equal if identical once white space is deleted. Strings are dealt by
length and content hash into parts, and each part has one compressed radix trie of the full byte
strings: it descends byte by byte, so equal hashes alone never make two texts equal. A terminal node holds the best row so far.

* Each task first inserts a window of rows into ``PARTS`` tries and passes on one row for each terminal node, so that many
  copies of one text shrink to one for each window.
* Strings whose (length, hash) only one window has seen are done. The others travel, in full, to the task of their part
  and are inserted in sorted order into that part's trie. Subtrees to the left of the last string are complete; when a trie
  holds more than ``SPILL_BYTES`` they are written out and dropped.
* Rows find their owner by the content hash of their string; texts are not written or shuffled for it
  as long as the owners of repeated texts fit a broadcast.

Cases: null counts as the empty text, and empty texts are copies of each
other; of equal texts the row with the most code points stays, then the
smallest doc_id (null last; of strings the first in byte order), and of rows that agree in both one, the first by text;
an empty table gives an empty result; all columns of the input
pass through, whatever their names. Texts of different bytes that share a length and a SHA-256 raise an error.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import counted_join, materialize, partitions, sized_broadcast, table

#: Bytes of distinct strings that a task holds before it passes them on.
WINDOW_BYTES = 32 << 20
#: Rows that a task holds before it passes them on.
WINDOW_ROWS = 100_000
#: Tries of a window.
PARTS = 64
#: Bytes of strings in a trie beyond which its complete subtrees are written out.
SPILL_BYTES = 64 << 20
WHITE = b" \t\n\x0b\x0c\r"
OWN = "__owner"


class Node:
    __slots__ = ("kids", "label", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value, self.kids = label, value, {}


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``put`` returns the terminal node of a string."""

    def __init__(self):
        self.root = Node(b"")

    def put(self, key: bytes) -> Node:
        node, at = self.root, 0
        while True:
            if at == len(key):
                return node
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = kid = Node(key[at:])
                return kid
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = _common(label, key, at)
            middle = Node(label[:same])
            kid.label = label[same:]
            middle.kids[kid.label[0]] = kid
            node.kids[key[at]] = middle
            node, at = middle, at + same


def _common(label: bytes, key: bytes, at: int) -> int:
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[:mid] == key[at : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _better(a: tuple, b: tuple) -> bool:
    """Whether (points, doc_id) ``a`` stays rather than ``b``."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] is None or b[1] is None:
        return b[1] is None and a[1] is not None
    return a[1] < b[1]


def _merge(node: Node, sha: str, points: int, doc_id, ties: int, count: int) -> bool:
    """Add rows to a terminal node: how many, the best of them and how many are as good. True if the node is new."""
    v = node.value
    if v is None:
        node.value = [sha, points, doc_id, ties, count]
        return True
    v[4] += count
    if (points, doc_id) == (v[1], v[2]):
        v[3] += ties
    elif _better((points, doc_id), (v[1], v[2])):
        v[1:4] = points, doc_id, ties
    return False


def _terminals(node: Node, key: bytes = b""):
    """(string, value) of all terminal nodes of a subtree."""
    todo = [(node, key)]
    while todo:
        node, key = todo.pop()
        key += node.label
        if node.value is not None:
            yield key, node.value
        todo.extend((kid, key) for kid in node.kids.values())


def _spilled(trie: PatriciaTrie, last: bytes):
    """Write out what does not lie on the path to ``last``: with sorted strings it is complete."""
    node, at = trie.root, 0
    while at < len(last):
        path = node.kids[last[at]]
        for kid in list(node.kids.values()):
            if kid is not path:
                yield from _terminals(kid, last[:at])
        node.kids = {last[at]: path}
        if node.value is not None:
            yield last[:at], node.value
            node.value = None
        node, at = path, at + len(path.label)


_FIELDS = ["part", "length", "sha", "points", "doc", "ties", "count", "string"]


def _schema(key: str, with_strings: bool) -> str:
    return f"part int, length int, sha string, points long, doc {key}, ties long, count long" + ", string binary" * with_strings


def _rows(found: list[tuple], id_type: pa.DataType, with_strings: bool):
    """Record batches of (string, [sha, points, doc, ties, count])."""
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.binary()][: 7 + with_strings]
    for at in range(0, len(found), 1024):
        rows = [(_part(len(s), v[0]), len(s), *v, s) for s, v in found[at : at + 1024]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=_FIELDS[: 7 + with_strings])


def _part(length: int, sha: str) -> int:
    return (length + int(sha[:8], 16)) % (1 << 20)


def _local(batches, with_strings: bool):
    """One row for each distinct string of a window."""
    tries, size, n = [PatriciaTrie() for _ in range(PARTS)], 0, 0

    def found():
        return [x for trie in tries for x in _terminals(trie.root)]

    for whole in batches:
        id_type = whole.schema.field("doc_id").type
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                text = text or ""
                key = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
                sha = hashlib.sha256(key).hexdigest()
                if _merge(tries[_part(len(key), sha) % PARTS].put(key), sha, len(text), doc_id, 1, 1):
                    size += len(key) + 500
            n += batch.num_rows
            if size > WINDOW_BYTES or n > WINDOW_ROWS:
                yield from _rows(found(), id_type, with_strings)
                tries, size, n = [PatriciaTrie() for _ in range(PARTS)], 0, 0
    if n:
        yield from _rows(found(), id_type, with_strings)


def _owners(batches):
    """Rows sorted by part and string: each string's owner over all windows."""
    part, trie, size, out = None, PatriciaTrie(), 0, []
    for batch in batches:
        id_type = batch.schema.field("doc").type
        for p, key, sha, points, doc_id, ties, count in zip(*(batch.column(c).to_pylist() for c in ("part", "string", "sha", "points", "doc", "ties", "count")), strict=True):
            if p != part:
                out += _terminals(trie.root)
                part, trie, size = p, PatriciaTrie(), 0
            if _merge(trie.put(key), sha, points, doc_id, ties, count):
                size += len(key) + 500
            if size > SPILL_BYTES:
                out += _spilled(trie, key)
                size = len(key) + 500
            if len(out) >= 1024:
                yield from _rows(out, id_type, False)
                out = []
    out += _terminals(trie.root)
    if out:
        yield from _rows(out, id_type, False)


def _sha(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)


def owners(docs: DataFrame) -> DataFrame:
    """(sha, points, doc, ties, count) of each text that several rows of ``docs`` (doc_id, text) have: the best row's code points and id, how many rows have these, and how many the text."""
    spark, key = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    seen = materialize(docs.mapInArrow(lambda batches: _local(batches, False), _schema(key, False)), "dedup-seen")
    groups = seen.groupBy("length", "sha").agg(F.count("*").alias("windows"), F.sum("count").alias("rows")).filter("rows > 1")
    groups = materialize(groups, "dedup-groups")
    several = materialize(groups.filter("windows > 1").select("length", "sha"), "dedup-several")
    strings = docs.mapInArrow(lambda batches: _local(batches, True), _schema(key, True)).join(sized_broadcast(several), ["length", "sha"], "left_semi")
    n = partitions(spark)
    dealt = strings.withColumn("part", F.col("part") % n).repartition(n, "part").sortWithinPartitions("part", "string")
    met = dealt.mapInArrow(_owners, _schema(key, False))
    met = materialize(met, "dedup-owners").select("sha", "points", "doc", "ties", "count")
    clash = met.groupBy("sha").count().filter("count > 1").select(F.assert_true(F.lit(False), "different texts with one hash")).collect()
    assert not clash
    alone = seen.join(sized_broadcast(groups.filter("windows = 1").select("length", "sha")), ["length", "sha"], "left_semi").select(*met.columns)
    return materialize(met.unionByName(alone), "dedup-owned")


def annotate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", only_kept: bool = False) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256, in columns whose names begin with ``__owner`` (``OWN``)."""
    own = lambda x: F.col(OWN + x)
    text, doc_id = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    found = owners(docs.select(doc_id.alias("doc_id"), text.alias("text")))
    found = found.withColumnsRenamed({"sha": f"{OWN}_sha", "points": f"{OWN}_points", "doc": f"{OWN}_doc", "ties": f"{OWN}_ties", "count": f"{OWN}_count"})
    found = found.withColumn(f"{OWN}_key", own("_sha")).withColumn(f"{OWN}_n", own("_count"))
    named = docs.withColumn(f"{OWN}_sha", _sha(text))
    # a text of very many rows is joined by broadcast, others may shuffle
    joined = counted_join(named, found, f"{OWN}_sha", f"{OWN}_n")
    lone = own("_key").isNull()
    best = lone | ((F.length(F.coalesce(text, F.lit(""))) == own("_points")) & doc_id.eqNullSafe(own("_doc")))
    joined = joined.withColumn(f"{OWN}_kept", best).withColumn(f"{OWN}_keep_id", F.when(lone, doc_id).otherwise(own("_doc"))).withColumn(f"{OWN}_group_size", F.coalesce(own("_count"), F.lit(1)).cast("long"))
    joined = joined.filter(own("_kept")) if only_kept else joined
    if not found.filter(own("_ties") > 1).isEmpty():
        # rows that agree in id and code points with their text's owner: one of them stays
        tied = own("_kept") & F.coalesce(own("_ties") > 1, F.lit(False))
        held = materialize(joined.filter(tied).withColumn(f"{OWN}_row", F.monotonically_increasing_id()), "dedup-tied")
        first = held.groupBy(f"{OWN}_sha").agg(F.min(F.struct(text, own("_row")))[f"{OWN}_row"].alias(f"{OWN}_first")).select(f"{OWN}_first")
        chosen = held.join(sized_broadcast(materialize(first, "dedup-first")), own("_row") == own("_first"), "left").withColumn(f"{OWN}_kept", own("_first").isNotNull()).drop(f"{OWN}_row", f"{OWN}_first")
        joined = joined.filter(~tied).unionByName(chosen.filter(own("_kept")) if only_kept else chosen)
    return joined


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return annotate(docs, text_col, id_col, only_kept=True).select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(f"{OWN}_keep_id").alias("keep_id"), F.col(f"{OWN}_group_size").alias("group_size"), F.col(f"{OWN}_kept").alias("kept"), F.col(f"{OWN}_sha").alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
w AS (SELECT doc_id, sha256(norm) AS text_sha256, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
