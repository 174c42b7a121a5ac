"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of ``ROLL`` neighbouring lines chooses boundary lines: it fires at a line in proportion to the line's bytes,
always from ``TARGET`` bytes on, so boundaries come back into step right after lines are inserted or removed, text has them densely and long lists of tiny lines sparsely. A chunk goes
from one boundary line to the next, both included; chunks so have two lines at least, share their boundary lines,
and depend on nothing outside but the line before their first. Of a chunk with several places in all documents the first (smallest doc_id, then line) is the owner. At
every other place the chunk's lines go, and with them the tiny lines around it, up to the next boundary line, as far as they equal those around the owner: the run
that both share is removed to its full length. No line goes that belongs to the owner's side of such a run: one whole copy of each repeated
chunk and run stays in one place.

Hashes only select candidates: places count as the same if all their bytes agree. Chunks are counted by hash first, summed before they are shuffled, and only then are
bytes made, of repeated chunks alone. Keys that many places have are joined by ``counted_join``, so no chunk of a third of all documents meets in one task.

A document is a doc_id with a text: rows of one id, or without one, that hold different texts are different documents, told apart by a 64-bit hash of the text.

Cases: null counts as empty and stays as it is; empty texts, texts with fewer than two boundary lines and lines without a word between chunks are left alone; a line without a word is never a boundary;
rows that repeat an id and a text share its places, so they neither count as repeats nor lose their first place; a chunk that overlaps its own first place stays;
null ids come first; of one id the text with the lowest hash comes first; an empty table gives an empty result; all columns of the input pass through ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from weftline.llm.common import counted_join, discard, materialize, sized_broadcast, slices, table

ROLL = 2
#: Lines of at least so many bytes are boundaries; shorter ones in proportion.
TARGET = 12
#: Fixed values of the rolling hash: bits of a line's hash, the multiplier, and the bits that decide.
HASH_BITS, TIMES, SHIFT, SHARES = 48, 31, 20, 1024
DROP = "__line_chunks"
RANGE = "struct<a:int,b:int>"


def boundaries(lines: list[bytes]) -> list[int]:
    """Numbers of the boundary lines."""
    h = [int.from_bytes(hashlib.md5(x, usedforsecurity=False).digest()[: HASH_BITS // 8], "big") for x in lines]
    out, mask = [], (1 << HASH_BITS) - 1
    for i, x in enumerate(lines):
        rolled = 0
        for k in range(max(0, i - ROLL + 1), i + 1):
            rolled = (rolled * TIMES + h[k]) & mask
        if ((rolled >> SHIFT) % SHARES) * TARGET < len(x) * SHARES and x.strip(b" \t\n\x0b\x0c\r"):
            out.append(i)
    return out


def chunks(text: str | None) -> tuple[list[bytes], list[int]]:
    """Lines of a whole text, and its boundary lines; a chunk goes from each to the next, both included."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    return lines, boundaries(lines)


def _digests(batches):
    """(doc_id, mark, number, digest): the chunks of each text."""
    import xxhash

    for whole in batches:
        for batch in slices(whole, 2):
            row, number, digest = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines, ends = chunks(text)
                row += [i] * (len(ends) - 1)
                number += range(len(ends) - 1)
                digest += [xxhash.xxh3_64_intdigest(b"\n".join(lines[a : b + 1])) for a, b in zip(ends, ends[1:])]
            own = [batch.column(c).take(pa.array(row, pa.int32())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), pa.array(np.array(digest, np.uint64).view(np.int64))], names=["doc_id", "mark", "number", "digest"])


def _pieces(batches):
    """The asked chunks of each text: their bytes, their lines [a, b), and the lines above (nearest first) and below, up to the next boundaries."""
    import xxhash

    names = ["doc_id", "mark", "number", "digest", "chunk", "a", "b", "above", "below"]
    for whole in batches:
        for batch in slices(whole, 2):
            row, out = [], {c: [] for c in names[2:]}
            for i, (text, numbers) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                lines, ends = chunks(text)
                for n in numbers:
                    a, b = ends[n], ends[n + 1]
                    chunk = b"\n".join(lines[a : b + 1])
                    row.append(i)
                    before = ends[n - 1] + 1 if n else 0
                    after = ends[n + 2] if n + 2 < len(ends) else len(lines)
                    for c, v in zip(names[2:], (n, xxhash.xxh3_64_intdigest(chunk), chunk, a, b + 1, lines[before:a][::-1], lines[b + 1 : after]), strict=True):
                        out[c].append(v)
            own = [batch.column(c).take(pa.array(row, pa.int32())) for c in (0, 1)]
            kinds = {"chunk": pa.binary(), "above": pa.list_(pa.binary()), "below": pa.list_(pa.binary())}
            rest = [pa.array(np.array(v, np.uint64).view(np.int64)) if c == "digest" else pa.array(v, kinds.get(c, pa.int32())) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([*own, *rest], names=names)


def _equal(x, y):
    """How many elements two arrays of lines begin with in common."""
    n = F.least(F.size(x), F.size(y))
    same = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q)
    differ = F.array_position(same, False)
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(n)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, gone, kept): ranges of lines of each document of ``docs`` (doc_id, mark, text) that repeat an earlier place, and ranges that stay all the same, as the first places of others; documents without the former are left out."""
    docs = docs.select("doc_id", "mark", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    place = F.struct("doc_id", "mark", "number")
    slim = materialize(docs.mapInArrow(_digests, f"doc_id {key}, mark long, number int, digest long"), "lines-digests")
    twice = slim.groupBy("digest").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("digest", F.lit(True).alias("twice"), "n")
    twice = materialize(twice, "lines-repeated")
    asked = counted_join(slim, twice, "digest").filter("twice").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    asked = materialize(asked, "lines-asked").withColumnsRenamed({"doc_id": "__d", "mark": "__m"})
    wanted = docs.join(sized_broadcast(asked, weight=F.size("numbers") * 4), docs["doc_id"].eqNullSafe(F.col("__d")) & (docs["mark"] == F.col("__m")))
    schema = f"doc_id {key}, mark long, number int, digest long, chunk binary, a int, b int, above array<binary>, below array<binary>"
    found = materialize(wanted.select("doc_id", "mark", "text", "numbers").mapInArrow(_pieces, schema), "lines-places")
    # the first place of each chunk, and what stands around it
    owner = F.min(F.struct("doc_id", "mark", "number", "a", "b", "above", "below")).alias("first")
    kinds = materialize(found.groupBy("digest", "chunk").agg(owner, F.max(place).alias("last"), F.count("*").alias("n")), "lines-kinds")
    several = materialize(kinds.groupBy("digest").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).filter("kinds > 1").select("digest", F.lit(True).alias("several"), "n"), "lines-several")
    repeated = (F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.mark") == F.col("last.mark")) & (F.col("first.number") == F.col("last.number"))).alias("once")
    owners = counted_join(kinds.select("digest", "chunk", "first", "n", repeated), several, "digest").filter("NOT once").drop("once")
    marked = counted_join(found, several, "digest")
    # a digest of one kind of bytes tells its places by itself; bytes meet once more only where several kinds share a digest
    by_digest = materialize(owners.filter("several IS NULL").select("digest", "first", "n"), "lines-owners")
    by_bytes = owners.filter("several").select("digest", "chunk", "first")
    columns = ["doc_id", "mark", "number", "a", "b", "above", "below", "first"]
    owned = counted_join(marked.filter("several IS NULL"), by_digest, "digest").filter("first IS NOT NULL").select(*columns)
    owned = owned.unionByName(marked.filter("several").join(by_bytes, ["digest", "chunk"]).select(*columns))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    own = same & (F.col("number") == F.col("first.number"))
    # a place in the same document that shares lines with the first one is part of it
    apart = ~same | (F.col("a") >= F.col("first.b"))
    runs = owned.filter(~own & apart).withColumn("up", _equal(F.col("above"), F.col("first.above"))).withColumn("down", _equal(F.col("below"), F.col("first.below")))
    # in one document a run does not grow into its owner's
    runs = runs.withColumn("up", F.when(same, F.least("up", F.col("a") - F.col("first.b"))).otherwise(F.col("up"))).withColumn("down", F.when(same, F.least("down", F.col("a") - F.col("first.b") - F.col("up"))).otherwise(F.col("down")))
    runs = materialize(runs.select("doc_id", "mark", "a", "b", "up", "down", F.struct("first.doc_id", "first.mark", "first.a", "first.b").alias("first")), "lines-runs")
    gone = runs.select("doc_id", "mark", F.struct((F.col("a") - F.col("up")).alias("a"), (F.col("b") + F.col("down")).alias("b")).alias("r"))
    kept = runs.groupBy("first").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    kept = kept.select("first.doc_id", "first.mark", F.struct((F.col("first.a") - F.col("up")).alias("a"), (F.col("first.b") + F.col("down")).alias("b")).alias("r"))
    both = gone.withColumn("kind", F.lit(0)).unionByName(kept.withColumn("kind", F.lit(1))).groupBy("doc_id", "mark", "kind").agg(F.sort_array(F.collect_set("r")).alias("r"))
    ranges = both.groupBy("doc_id", "mark").agg(*(F.coalesce(F.first(F.when(F.col("kind") == k, F.col("r")), ignorenulls=True), F.array().cast(f"array<{RANGE}>")).alias(name) for k, name in ((0, "gone"), (1, "kept"))))
    out = materialize(ranges.filter(F.size("gone") > 0), "lines-gone")
    discard(slim, twice, found, kinds, several, by_digest, runs)
    return out


def _without(batches, text_at: int):
    for whole in batches:
        for batch in slices(whole, text_at):
            texts, n_lines, dropped = [], [], []
            gone, kept = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            for text, out, stay in zip(batch.column(text_at).to_pylist(), gone, kept, strict=True):
                n_lines.append(text.count("\n") + 1 if text else 0)
                drop: set[int] = set()
                if out:
                    drop = {k for r in out for k in range(r["a"], r["b"])} - {k for r in stay for k in range(r["a"], r["b"])}
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                dropped.append(len(drop))
                texts.append(text)
            columns = [*batch.columns[:-2], pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64())]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], f"{DROP}_lines", f"{DROP}_removed"])


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with repeated runs of lines removed from the text; two columns whose names begin with ``DROP`` count lines before and lines removed."""
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    gone = repeats(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), mark.alias("mark"))).withColumnsRenamed({x: f"{DROP}_{x}" for x in ("doc_id", "mark", "gone", "kept")})
    same = docs[id_col].eqNullSafe(F.col(f"{DROP}_doc_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col(f"{DROP}_mark"))
    weight = (F.size(f"{DROP}_gone") + F.size(f"{DROP}_kept")) * 8
    joined = docs.join(sized_broadcast(gone, weight=weight), same, "left").drop(f"{DROP}_doc_id", f"{DROP}_mark")
    schema = StructType([*docs.schema.fields]).add(f"{DROP}_lines", LongType()).add(f"{DROP}_removed", LongType())
    text_at = docs.columns.index(text_col)
    return joined.mapInArrow(lambda batches: _without(batches, text_at), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col(f"{DROP}_lines").alias("n_lines"), F.col(f"{DROP}_removed").alias("n_removed_lines"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cleaned_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("cleaned_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM d),
h AS (SELECT *, ('0x' || md5(x)[1:{HASH_BITS // 4}])::BIGINT AS h FROM e),
r AS (SELECT *, ({TIMES} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) + h) & {(1 << HASH_BITS) - 1} AS rolled FROM h),
s AS (SELECT doc_id, i, x FROM r WHERE ((rolled >> {SHIFT}) % {SHARES}) * {TARGET} < strlen(x) * {SHARES} AND regexp_matches(x, '[^\x20\x09-\x0D]')),
c AS (SELECT s.doc_id, i AS a, lead(i) OVER o AS b, coalesce(lag(i) OVER o, 0) AS before, lead(i, 2) OVER o AS after, len(l) AS n, l FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, a, b, array_to_string(l[a:b], chr(10)) AS p, list_reverse(l[before + 1:a - 1]) AS above, l[b + 1:coalesce(after - 1, n)] AS below FROM c WHERE b IS NOT NULL),
g AS (SELECT *, first_value(doc_id) OVER w AS od, first_value(a) OVER w AS oa, first_value(b) OVER w AS ob, first_value(above) OVER w AS oabove, first_value(below) OVER w AS obelow FROM k WINDOW w AS (PARTITION BY p ORDER BY doc_id, a)),
z AS (SELECT *, list_position(list_transform(range(1, least(len(above), len(oabove)) + 1), lambda j: above[j] = oabove[j]), false) AS u, list_position(list_transform(range(1, least(len(below), len(obelow)) + 1), lambda j: below[j] = obelow[j]), false) AS v FROM g WHERE doc_id <> od OR a > ob),
y AS (SELECT *, CASE WHEN coalesce(u, 0) > 0 THEN u - 1 ELSE least(len(above), len(oabove)) END AS up0, CASE WHEN coalesce(v, 0) > 0 THEN v - 1 ELSE least(len(below), len(obelow)) END AS down0 FROM z),
y1 AS (SELECT *, CASE WHEN doc_id = od THEN least(up0, a - ob - 1) ELSE up0 END AS up FROM y),
y2 AS (SELECT *, CASE WHEN doc_id = od THEN least(down0, a - ob - 1 - up) ELSE down0 END AS down FROM y1),
kept AS (SELECT DISTINCT od AS doc_id, unnest(range(oa - max(up), ob + max(down) + 1)) AS i FROM y2 GROUP BY od, oa, ob),
gone AS (SELECT DISTINCT doc_id, unnest(range(a - up, b + down + 1)) AS i FROM y2),
x AS (SELECT doc_id, list(i) AS gone, count(*) AS m FROM gone ANTI JOIN kept USING (doc_id, i) GROUP BY doc_id),
f AS (SELECT d.doc_id, CASE WHEN text = '' THEN 0 ELSE len(l) END AS n_lines, coalesce(m, 0) AS n_removed_lines, CASE WHEN m IS NULL THEN text ELSE array_to_string(list_transform(list_filter(generate_series(1, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)) END AS cleaned FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n_lines, n_removed_lines, length(cleaned) AS cleaned_chars, sha256(cleaned) AS cleaned_sha256 FROM f
"""
