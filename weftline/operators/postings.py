"""The best documents of many queries by common n-grams, where some n-grams stand in very many documents.

N-grams that at most ``RARE`` documents hold are met with each of these. Of the others, the hot ones, documents are put into blocks of similar sets of them, and a query
is met with blocks: the hot n-grams of a block bound what any of its documents can have, and blocks that cannot reach a query's
``top`` best known documents are never read. A block that is read is scored as a whole in one step, and only its ``top`` best documents leave it. The rows that are
shuffled so grow with queries times blocks that can matter, not with queries times documents that hold a hot n-gram.

Where only the first document of each of very many queries is asked for (``first_documents``), postings are files that tasks read, a part of the documents and a part of
the queries at a time: what meets is counted in the task and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import edit
from weftline.operators.joins import counted_join
from weftline.operators.sequence import ordered_ids
from weftline.sources.scratch import _delete, let_go, scratch, settled
from weftline.sources.sinks import _store

#: Documents of a block, and queries that are scored against a block at once.
BLOCK, QUERIES_AT_ONCE = 1024, 256
#: Parts into which the blocks that hold a hot n-gram are dealt.
SALTS = 16


def hot_blocks(index: DataFrame, hot: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, doc, grams): documents with hot n-grams (``index``: gram, doc; ``hot``: gram, gid, n), those with as many and then with the same ones next to each other."""
    held = counted_join(index, hot, "gram").filter("gid IS NOT NULL").groupBy("doc").agg(F.sort_array(F.collect_list("gid")).alias("grams"))
    placed = ordered_ids(held.withColumn("size", F.size("grams")), F.struct("size", "grams", "doc"), "place", 0)
    return placed.select(F.floor(F.col("place") / block).cast("long").alias("block"), "doc", "grams")


def bounds(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(kid, block, bound): of queries ``asked`` (kid, gid, times), what the hot n-grams of any document of a block can add up to at most: all that the block holds, and as many as its largest document."""
    tops = blocks.groupBy("block").agg(F.max(F.size("grams")).alias("most"))
    held = blocks.select("block", F.explode("grams").alias("gid")).distinct().withColumn("salt", F.col("block") % SALTS)
    spread = asked.withColumn("salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS)))))
    met = held.join(spread, ["gid", "salt"]).groupBy("kid", "block").agg(F.sum("times").alias("sum"), F.max("times").alias("high"))
    return met.join(tops, "block").select("kid", "block", F.least("sum", F.col("high") * F.col("most")).alias("bound"))


def _score(batches, top: int, doc_type):
    for batch in batches:
        for row in batch.to_pylist():
            docs, sizes = [x["doc"] for x in row["docs"]], [len(x["grams"]) for x in row["docs"]]
            flat = np.array([g for x in row["docs"] for g in x["grams"]], np.int64)
            owner = np.repeat(np.arange(len(docs)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            place = {d: i for i, d in enumerate(docs)}
            kid, doc, hits = [], [], []
            for q in row["queries"]:
                score = np.zeros(len(docs), np.int64)
                gids, times = np.array(q["gids"], np.int64), np.array(q["times"], np.int64)
                lo, hi = np.searchsorted(flat, gids), np.searchsorted(flat, gids, "right")
                for a, b, t in zip(lo.tolist(), hi.tolist(), times.tolist(), strict=True):
                    score[owner[a:b]] += t  # a document holds a gram once
                for x in q["rare"]:
                    score[place[x["doc"]]] += x["rare"]
                best = np.lexsort((np.arange(len(docs)), -score))[:top]  # documents come in order
                for i in best[score[best] > 0].tolist():
                    kid.append(q["kid"])
                    doc.append(docs[i])
                    hits.append(int(score[i]))
            yield pa.RecordBatch.from_arrays([pa.array(kid, pa.int64()), pa.array(doc, doc_type), pa.array(hits, pa.int64())], names=["kid", "doc", "hits"])


def scored(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, rare: DataFrame, top: int) -> DataFrame:
    """(kid, doc, hits): the ``top`` best documents of each of ``pairs`` (kid, block), counting hot n-grams and ``rare`` (kid, block, doc, rare)."""
    from pyspark.sql.pandas.types import to_arrow_type

    lists = asked.groupBy("kid").agg(F.collect_list(F.struct("gid", "times")).alias("g"))
    known = rare.filter("block IS NOT NULL").join(pairs, ["kid", "block"], "left_semi").groupBy("kid", "block").agg(F.collect_list(F.struct("doc", "rare")).alias("rare"))
    none = F.array().cast(known.schema["rare"].dataType)
    gids = lambda c, kind: F.coalesce(F.col(f"g.{c}"), F.array().cast(kind)).alias(c if c == "times" else "gids")
    full = pairs.join(lists, "kid", "left").join(known, ["kid", "block"], "left")
    query = F.struct("kid", gids("gid", "array<bigint>"), gids("times", "array<bigint>"), F.coalesce("rare", none).alias("rare"))
    # so many queries at once are one row, and a block one row
    number = F.row_number().over(Window.partitionBy("block").orderBy("kid")) - 1
    sets = full.select("block", query.alias("q"), F.floor(number / QUERIES_AT_ONCE).alias("part")).groupBy("block", "part").agg(F.collect_list("q").alias("queries"))
    bodies = blocks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc", "grams"))).alias("docs"))
    kind = blocks.schema["doc"].dataType
    # scoring a row costs far more than its bytes suggest
    return edit.spread(sets.join(bodies, "block").select("docs", "queries")).mapInArrow(lambda batches: _score(batches, top, to_arrow_type(kind)), f"kid long, doc {kind.simpleString()}, hits long")


def best_documents(counted: DataFrame, keys: list[str], index: DataFrame, top: int, rare_documents: int = 1000, block: int = BLOCK, met: list | None = None) -> DataFrame:
    """(keys, doc, hits): how often the n-grams of ``counted`` (keys, gram, times) stand in a document of ``index`` (gram, doc), for every document that can be among the ``top`` first by hits, then doc.

    Pairs (kid, block) that were read are appended to ``met`` as a table, if it is given.
    """
    index = settled(index)
    sizes = settled(index.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > rare_documents))
    if sizes.isEmpty():
        return counted.join(index, "gram").groupBy(*keys, "doc").agg(F.sum("times").alias("hits"))
    # the hot n-gram with the fewest documents is number 0
    hot = settled(ordered_ids(sizes, F.struct("n", "gram"), "gid", 0))
    queries = settled(settled(counted.select(*keys).distinct()).withColumn("kid", F.monotonically_increasing_id()))
    named = queries.select("kid", *(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & counted[k].eqNullSafe(F.col(f"__{k}"))
    numbered = settled(counted.join(named, same).select("kid", "gram", F.col("times").cast("long").alias("times")))
    blocks = settled(hot_blocks(index, hot, block))
    asked = settled(numbered.join(hot, "gram").select("kid", "gid", "times"))
    rare = numbered.join(counted_join(index, hot, "gram").filter("gid IS NULL").select("gram", "doc"), "gram").groupBy("kid", "doc").agg(F.sum("times").alias("rare"))
    rare = settled(rare.join(blocks.select("block", "doc"), "doc", "left"))
    best_known = F.row_number().over(Window.partitionBy("kid").orderBy(F.desc("hits")))
    at_least = lambda rows: rows.withColumn("r", best_known).filter(F.col("r") == top).select("kid", F.col("hits").alias("floor"))
    # what a document of a block can reach: its rare n-grams are known
    reach = bounds(asked, blocks).join(rare.filter("block IS NOT NULL").groupBy("kid", "block").agg(F.max("rare").alias("rare")), ["kid", "block"], "full")
    reach = settled(reach.select("kid", "block", (F.coalesce("bound", F.lit(0)) + F.coalesce("rare", F.lit(0))).alias("bound")))
    first = settled(reach.groupBy("kid").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block")))
    found = settled(scored(first, asked, blocks, rare, top))
    # the same document may be known by its rare n-grams alone, which is less
    known = found.unionByName(rare.select("kid", "doc", F.col("rare").alias("hits"))).groupBy("kid", "doc").agg(F.max("hits").alias("hits"))
    floors = settled(at_least(known))
    left = reach.join(first, ["kid", "block"], "left_anti").join(floors, "kid", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0)))
    left = settled(left.select("kid", "block"))
    more = scored(left, asked, blocks, rare, top)
    alone = rare.filter("block IS NULL").select("kid", "doc", F.col("rare").alias("hits"))
    out = settled(found.unionByName(more).unionByName(alone))
    if met is not None:
        met.append(settled(first.unionByName(left)))
    let_go(index, sizes, hot, numbered, blocks, asked, rare, reach, first, found, floors, left)
    return out.join(queries, "kid").select(*keys, "doc", "hits")


#: Postings of a part of the documents and n-grams of a part of the queries, which a task holds at once, and the fewest that are worth a part.
PART_ROWS, LEAST_ROWS = 1 << 20, 1 << 15
#: Meetings of n-grams of queries and documents that are sorted at once.
MEETINGS = 1 << 21
#: An n-gram that a larger share of a part's documents hold is added up over all of these, once for all queries with the same n-grams of that kind.
COMMON = 1 / 64


def _parted(rows: DataFrame, by: str, order: list[str], parts: int, label: str) -> str:
    """Writes ``rows`` (gid, ...) to files by ``by`` modulo ``parts``, in the order of ``order``."""
    path = scratch(rows.sparkSession, label)
    dealt = rows.withColumn("part", F.pmod(F.col(by), F.lit(parts))).repartition(parts, "part").sortWithinPartitions("part", *order)
    dealt.write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def _part(path: str, part: int, columns: list[str]) -> list[np.ndarray]:
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = _store(path)
    folder = f"{path}/part={part}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return [np.empty(0, np.int64) for _ in columns]
    t = ds.dataset(folder, filesystem=store, format="parquet").to_table(columns=columns)
    return [t.column(c).to_numpy().astype(np.int64, copy=False) for c in columns]


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0] ... lo[0] + n[0] - 1, lo[1] ... one after another."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``sizes`` that add up to ``most`` at most, or of one that is larger."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _sums(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, and the sums of their ``times``."""
    if (times == 1).all():
        key = np.sort(key)
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[heads], np.diff(np.append(heads, len(key)))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[heads], np.add.reduceat(times, heads)


def _firsts(posts: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kid, did, hits): of the documents of ``posts`` (gid, did; in order) the first by hits, then did, for each query of ``asked`` (kid, gid, times; by kid) that has any."""
    gid, did = posts
    docs, place = np.unique(did, return_inverse=True)
    known, begs, counts = np.unique(gid, return_index=True, return_counts=True)
    kid, wanted, times = asked
    if not len(known) or not len(kid):
        return
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    found = known[at] == wanted
    kid, at, times = kid[found], at[found], times[found]
    if not len(kid):
        return
    kids, heads, rows = np.unique(kid, return_index=True, return_counts=True)
    met = counts[at]
    common = met > max(MEETINGS >> 15, len(docs) * COMMON)
    # a query with more meetings than are sorted at once is added up over all documents as well
    common |= np.repeat(np.add.reduceat(np.where(common, 0, met), heads) > MEETINGS, rows)
    owner = np.repeat(np.arange(len(kids)), rows)
    # queries with the same common n-grams, as often, have the same number; 0 has none
    sets: dict[bytes, int] = {b"": 0}
    number = np.zeros(len(kids), np.int64)
    members: list[tuple[np.ndarray, np.ndarray]] = [(at[:0], times[:0])]
    some, first, size = np.unique(owner[common], return_index=True, return_counts=True)
    c_at, c_times = at[common], times[common]
    for q, a, n in zip(some.tolist(), first.tolist(), size.tolist(), strict=True):
        order = np.argsort(c_at[a : a + n])
        mine = c_at[a : a + n][order], c_times[a : a + n][order]
        number[q] = sets.setdefault(mine[0].tobytes() + mine[1].tobytes(), len(sets))
        if number[q] == len(members):
            members.append(mine)
    # queries of one set stand together
    line = np.argsort(number, kind="stable")
    rank = np.empty(len(line), np.int64)
    rank[line] = np.arange(len(line))
    number = number[line]
    order = np.argsort(rank[owner[~common]], kind="stable")
    r_owner, r_at, r_times = rank[owner[~common]][order], at[~common][order], times[~common][order]
    upto = np.searchsorted(r_owner, np.arange(len(line) + 1))
    load = np.zeros(len(line), np.int64)
    np.add.at(load, r_owner, counts[r_at])
    held, scores, best = 0, np.zeros(len(docs), np.int64), (0, 0)
    for a, b in _groups(load, MEETINGS):
        rows = slice(upto[a], upto[b])
        n = counts[r_at[rows]]
        key = np.repeat(r_owner[rows] - a, n) * len(docs) + place[_ranges(begs[r_at[rows]], n)]
        key, hits = _sums(key, np.repeat(r_times[rows], n)) if len(key) else (key, key)
        q, doc = key // len(docs), key % len(docs)
        cuts = np.searchsorted(q, np.arange(b - a + 1))
        top, top_doc = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        changes = [a, *(np.flatnonzero(number[a + 1 : b] != number[a : b - 1]) + a + 1).tolist(), b]
        for x, y in zip(changes[:-1], changes[1:], strict=True):
            k = int(number[x])
            if not k:
                continue
            if k != held:
                held, scores = k, np.zeros(len(docs), np.int64)
                for g, t in zip(members[k][0].tolist(), members[k][1].tolist(), strict=True):
                    scores[place[begs[g] : begs[g] + counts[g]]] += t  # a document holds a gram once
                best = int(scores.max()), int(scores.argmax())
            top[x - a : y - a], top_doc[x - a : y - a] = best
            mine = slice(cuts[x - a], cuts[y - a])
            hits[mine] += scores[doc[mine]]
        if len(key):
            having = np.flatnonzero(cuts[1:] > cuts[:-1])
            high = np.zeros(b - a, np.int64)
            high[having] = np.maximum.reduceat(hits, cuts[having])
            # documents of a query come in order
            firsts = np.flatnonzero(hits == high[q])
            firsts = firsts[np.concatenate([[True], q[firsts][1:] != q[firsts][:-1]])]
            mine, theirs = hits[firsts], doc[firsts]
            better = (mine > top[having]) | ((mine == top[having]) & (theirs < top_doc[having]))
            top[having[better]], top_doc[having[better]] = mine[better], theirs[better]
        yield kids[line[a:b]], docs[top_doc], top


def _met(batches, posts: str, asked: str, parts: int, queries: int):
    held, mine = -1, None
    for batch in batches:
        for unit in batch.column(0).to_pylist():
            if unit // queries != held:
                held = unit // queries
                mine = _part(posts, held, ["gid", "did"])
            for found in _firsts(mine, _part(asked, unit % queries, ["kid", "gid", "times"])):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["kid", "did", "hits"])


def first_documents(counted: DataFrame, keys: list[str], index: DataFrame, known: DataFrame) -> DataFrame:
    """(keys, doc, hits): of each query of ``counted`` (keys, gid, times) the first document by hits, then doc, of ``index`` (gram, doc); ``known``: settled (gram, gid). Queries without a hit are left out.

    Tasks read the postings of a part of the documents and the n-grams of a part of the queries; of a query only the first of each part leaves them. So what is written
    grows with queries times parts of documents, though all meetings are counted.
    """
    spark = index.sparkSession
    same = lambda left, right, c, d: left[c].eqNullSafe(right[d])
    docs = settled(ordered_ids(index.select("doc").distinct(), F.struct(F.col("doc").isNull(), "doc"), "did", 0))
    named = docs.withColumnRenamed("doc", "__doc")
    posts = settled(index.join(known, "gram").join(named, same(index, named, "doc", "__doc")).select("gid", "did"))
    counted = settled(counted)
    queries = settled(settled(counted.select(*keys).distinct()).withColumn("kid", F.monotonically_increasing_id()))
    numbers = queries.select("kid", *(F.col(k).alias(f"__{k}") for k in keys))
    on = F.lit(True)
    for k in keys:
        on = on & same(counted, numbers, k, f"__{k}")
    asked = settled(counted.join(numbers, on).select("kid", "gid", F.col("times").cast("long").alias("times")))
    rows, tasks = posts.count(), 2 * spark.sparkContext.defaultParallelism
    parts = max(1, -(-rows // PART_ROWS), min(tasks, rows // LEAST_ROWS))
    sets = max(1, -(-asked.count() // PART_ROWS))
    places = _parted(posts, "did", ["gid", "did"], parts, "posts"), _parted(asked.withColumn("__part", F.xxhash64("kid")), "__part", ["kid", "gid"], sets, "asked")
    units = spark.range(0, parts * sets, 1, min(parts * sets, max(4 * tasks, parts)))
    found = units.mapInArrow(lambda batches: _met(batches, *places, parts, sets), "kid long, did long, hits long")
    best = settled(found.groupBy("kid").agg(F.min(F.struct((-F.col("hits")).alias("less"), "did")).alias("b")).select("kid", F.col("b.did").alias("did"), (-F.col("b.less")).alias("hits")))
    for path in places:
        _delete(spark, path)
    let_go(posts, counted, asked)
    return best.join(queries, "kid").join(docs, "did").select(*keys, "doc", "hits")
