"""Token ids in Parquet: one row per document, ids in a list column.

Documents are dealt out by ranges of doc_id and sorted, so that file order is
doc_id order and row groups and pages cover narrow doc_id ranges. Row-group and
page sizes are parameters; the ids are dictionary encoded or, with
``encoding="delta"``, delta encoded. Parquet writes column and offset indexes,
so a read of some documents touches their pages only and a read of the
metadata columns leaves the ids alone.

Ids are those of the library without special tokens around a text; an added token inside a text has its own id, as there.

Cases: a null or empty text has the end id only; null doc_ids come first; rows
with the same doc_id stay separate, in order of their text; an empty table
gives an empty store; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import new_path, partitions, slices, table

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 256
#: Entries in each of the two generations of the cache of encoded words that a Python worker keeps: when the young one is full it replaces the old one, and words still in use move over.
CACHE_WORDS = 450_000

_WORKER: dict = {}
#: A piece, of several joined by U+0000, that may not be fit: all that are not are found, and a few more.
_UNFIT = re.compile(r"(?:^|\0)\n?(?:\s|\0|$)|\s(?:\0|$)")


def _tokenizer(path: str):
    if path not in _WORKER:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = sorted(x.content for x in t.get_added_tokens_decoder().values())
        vocab = t.get_vocab(with_added_tokens=False)
        # in a byte-level vocabulary each character of a token stands for a byte
        lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        lengths[list(vocab.values())] = list(map(len, vocab))
        _WORKER[path] = t, {}, {}, re.compile("|".join(map(re.escape, added)) or "(?!)"), lengths
    return _WORKER[path]


def _encode_words(tokenizer, lengths: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words that each begin with a space or a line feed and hold no other white space at their ends.

    Such words are pre-tokens apart, so many are encoded as one text and told apart by the bytes of their ids; a text for which these don't add up is encoded word by word.
    """
    out = []
    for at in range(0, len(words), 4096):
        some = words[at : at + 4096]
        ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(w.encode()) for w in some])
        upto = np.cumsum(lengths[ids]) if len(ids) and ids.max() < len(lengths) else np.zeros(0, np.int64)
        cuts = np.searchsorted(upto, ends)
        if len(upto) and cuts[-1] == len(upto) - 1 and (upto[cuts] == ends).all():
            raw, cuts = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        else:
            out += [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    return out


def _fit(piece: str) -> bool:
    """Whether a piece, after the line feed it may begin with, neither is empty nor has white space at its ends."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return body != "" and not body[0].isspace() and not body[-1].isspace()


def encode_texts(texts: list[str], tokenizer_path: str, end_id: int) -> list[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit integers.

    A single space or line feed between two characters of which neither is white space always begins a
    pre-token, so a text can be cut there and each distinct piece encoded once. Texts with other white space beside a
    cut, or with an added token (which the library finds before it cuts), are encoded whole.
    """
    tokenizer, cache, old, added, lengths = _tokenizer(tokenizer_path)
    if len(cache) > CACHE_WORDS:
        cache, old = {}, cache
        _WORKER[tokenizer_path] = tokenizer, cache, old, added, lengths
    split, values, gaps, unknown = [], [], [], set()
    for x in texts:
        if "  " in x or x[:1] == " " or x[-1:] in (" ", "\n") or added.search(x):
            p = v = None
            gap = ()
        else:
            # a piece after a line feed keeps it, one after a space doesn't
            p = x.replace("\n", " \n").split(" ")
            v = list(map(cache.get, p))
            v[0] = b""  # the first piece has no space before it
            gap = [i for i, y in enumerate(v) if y is None] if None in v else ()
            unknown.update(p[i] for i in gap)
        split.append(p)
        values.append(v)
        gaps.append(gap)
    # only pieces without white space at their ends are ever in the cache
    unfit = {w for w in unknown if (not w or w.strip() != w) and not _fit(w)} if _UNFIT.search("\0".join(unknown)) else set()
    for k, (p, gap) in enumerate(zip(split, gaps, strict=True)):
        if p is not None and (p[0] != p[0].rstrip() or p[0][:1] == "\n" or (not p[0] and len(p) > 1) or (unfit and any(p[i] in unfit for i in gap))):
            split[k] = values[k] = None
            gaps[k] = ()
    unknown -= unfit
    for w in [w for w in unknown if w in old]:
        cache[w] = old[w]
        unknown.discard(w)
    # a full stop or comma after letters is a pre-token of its own, so the word before it is enough
    marked = {w for w in unknown if w[-1:] in (".", ",") and w[:-1].isalpha()}
    stems = {w[:-1] for w in marked if w[:-1] not in cache}
    todo = list((unknown - marked) | stems)
    firsts = list(dict.fromkeys([p[0] for p in split if p and p[0]] + [".", ","]))
    whole = [x for x, p in zip(texts, split, strict=True) if p is None]
    cache.update(zip(todo, _encode_words(tokenizer, lengths, [w if w[0] == "\n" else " " + w for w in todo]), strict=True))
    done = [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(firsts + whole, add_special_tokens=False)]
    first = dict(zip(firsts, done, strict=False)) | {"": b""}
    cache.update((w, cache[w[:-1]] + first[w[-1]]) for w in marked)
    rest, end, out = iter(done[len(firsts) :]), int(end_id).to_bytes(4, "little"), []
    for p, v, gap in zip(split, values, gaps, strict=True):
        if p is None:
            out.append(next(rest) + end)
            continue
        v[0] = first[p[0]]
        for i in gap:
            v[i] = cache[p[i]]
        v.append(end)
        out.append(b"".join(v))
    return out


def _encoded(batches, tokenizer_path: str, end_id: int):
    pos = 0
    for whole in batches:
        for batch in slices(whole, whole.schema.get_field_index("text"), 512):
            raw = encode_texts([x or "" for x in batch.column("text").to_pylist()], tokenizer_path, end_id)
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            offsets = np.zeros(len(raw) + 1, np.int32)
            np.cumsum(n, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(raw))]))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(np.arange(pos, pos + len(raw), dtype=np.int64)), batch.column("doc_id"), pa.array(n), ids], names=["shard", "pos", "doc_id", "n_tokens", "ids"])
            pos += len(raw)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``docs`` (doc_id, text) and write the store at ``path``."""
    assert encoding in ("dictionary", "delta")
    key = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())
    rows = ordered.mapInArrow(lambda batches: _encoded(batches, tokenizer_path, end_id), f"shard int, pos long, doc_id {key}, n_tokens long, ids array<int>")
    (
        rows.write.option("compression", "snappy")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.writer.version", "v1" if encoding == "dictionary" else "v2")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Documents with lo <= doc_id <= hi; the bounds reach row groups and pages."""
    store = spark.read.parquet(path)
    store = store if lo is None else store.filter(F.col("doc_id") >= lo)
    return store if hi is None else store.filter(F.col("doc_id") <= hi)


def starts(store: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(shard, pos, doc_id, n_tokens, start): ids before each document, or ``rows`` (which have these columns) with ``start``. Reads the metadata columns only; sums within a shard, then over shards."""
    meta = store.select("shard", "pos", "doc_id", "n_tokens")
    rows = meta if rows is None else rows
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(shards, "shard").select(*rows.columns, (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def checksums(store: DataFrame) -> DataFrame:
    """(shard, pos, doc_id, n_tokens, ids_crc32) of the ids as stored."""
    key = store.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            raw, offsets = np.asarray(lists.values).astype("<u4", copy=False), np.asarray(lists.offsets)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "pos", "doc_id", "n_tokens")), pa.array(crc, pa.int64())], names=["shard", "pos", "doc_id", "n_tokens", "ids_crc32"])

    return store.select("shard", "pos", "doc_id", "n_tokens", "ids").mapInArrow(run, f"shard int, pos long, doc_id {key}, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    store = read_tokens(spark, path)
    return starts(store, checksums(store)).select("doc_id", "start", "n_tokens", "ids_crc32")
