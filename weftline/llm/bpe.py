"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than ``chunk_chars`` code points is cut into chunks that overlap.
The chunks are pre-tokenised in parallel. The pattern looks ahead but never
behind, so once two neighbouring chunks share a pre-token boundary in their
overlap they agree from there on; the text is cut at the first such boundary
and the pieces are encoded in parallel. Where no boundary is shared (one
pre-token spans an overlap) the document is encoded in one piece. Decoding
concatenates the raw bytes of the ids.

Cases: a null or empty text has no ids; a null id stays null; repeated rows and
ids each give a row; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import slices, table

#: Code points in a chunk, and shared by two neighbours.
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 10
#: A boundary this close to the end of its chunk may depend on what follows (contractions look two code points ahead).
GUARD_CHARS = 8
#: No text is cut into more chunks than this, so that cutting costs at most this many passes over it.
MOST_CHUNKS = 256
#: Bytes of text whose ids a task holds at once, as Python's numbers, which take some ten times as much.
SLICE_BYTES = 2 << 20

_CODECS: dict[tuple[str, str], "Codec"] = {}


class Codec:
    """A rank file's vocabulary: the merges are tiktoken's, the bytes of each id are its own table."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.digits = [b"%d" % i for i in range(size)]
        self.pattern = regex.compile(pattern)

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "Codec":
        key = (ranks_path, pattern)
        if key not in _CODECS:
            _CODECS[key] = cls(ranks_path, pattern)
        return _CODECS[key]

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def boundaries(self, text: str, lo: int, hi: int) -> list[int]:
        """Ends of pre-tokens in [lo, hi] at which the text can be cut: a cut after white space could change the pre-tokens before it."""
        return [m.end() for m in self.pattern.finditer(text) if lo <= m.end() <= hi and not text[m.end() - 1].isspace()]


def id_lists(lists: list) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1])) if len(lists) < 2 else np.concatenate([np.asarray(x, np.int32) for x in lists])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode_batches(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``keys`` columns and a text: the text is replaced by ``ids``. Slices of few rows and bytes keep the ids of a batch of long texts out of memory."""
    codec = Codec.of(ranks_path, pattern)
    for whole in batches:
        for batch in slices(whole, keys, 1024, SLICE_BYTES):
            ids = [codec.encode(x) if x else [] for x in batch.column(keys).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], id_lists(ids)], names=[*batch.schema.names[:keys], "ids"])


def _chunked(docs: DataFrame, text: str, chunk_chars: int, overlap: int) -> DataFrame:
    n = F.length(text)
    size = F.greatest(F.lit(chunk_chars), F.ceil(n / F.lit(MOST_CHUNKS)) + F.lit(overlap)).cast("int")
    step = size - F.lit(overlap)
    cuts = F.greatest(F.ceil((n - F.lit(overlap)) / step), F.lit(1)).cast("int")
    return (
        docs.withColumn("uid", F.monotonically_increasing_id())
        .select("uid", "key", F.col(text).alias("text"), size.alias("size"), step.alias("step"), cuts.alias("cuts"))
        .select("uid", "key", "cuts", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct((k * F.col("step")).alias("start"), F.substring(F.col("text"), k * F.col("step") + 1, F.col("size")).alias("chunk")))).alias("k", "c"))
        .select("uid", "key", "cuts", "k", "c.start", "c.chunk")
    )


def _pretokenised(batches, ranks_path, pattern, overlap):
    codec = Codec.of(ranks_path, pattern)
    for batch in (x for whole in batches for x in slices(whole, whole.schema.get_field_index("chunk"), 1024, SLICE_BYTES)):
        heads, tails = [], []
        for k, cuts, start, chunk in zip(*(batch.column(c).to_pylist() for c in ("k", "cuts", "start", "chunk")), strict=True):
            found = codec.boundaries(chunk, 1, len(chunk) - GUARD_CHARS)
            heads.append([start + p for p in found if k > 0 and p <= overlap])
            tails.append([start + p for p in found if k < cuts - 1 and p >= len(chunk) - overlap])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*batch.schema.names, "head", "tail"])


def encode(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, finish: Callable | None = None, finish_schema: str = "") -> DataFrame:
    """Rows (key, ids array<int>) of all texts; ``finish`` may turn batches of these rows into others (of ``finish_schema``) within the same task."""
    assert chunk_chars > 2 * overlap > 4 * GUARD_CHARS
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    key = docs.schema["key"].dataType.simpleString()
    schema = finish_schema or f"key {key}, ids array<int>"
    finish = finish or (lambda batches: batches)
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = docs.filter(~long).mapInArrow(lambda batches: finish(encode_batches(batches, ranks_path, pattern, 1)), schema)

    chunks = _chunked(docs.filter(long), "text", chunk_chars, overlap).repartition("uid", "k")
    fields = f"uid long, key {key}, cuts int, k int, start int, chunk string"
    chunks = chunks.mapInArrow(lambda batches: _pretokenised(batches, ranks_path, pattern, overlap), f"{fields}, head array<int>, tail array<int>")
    by_doc = Window.partitionBy("uid").orderBy("k")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(by_doc)))
    stitched = chunks.withColumn("cut", F.when(F.col("k") < F.col("cuts") - 1, cut)).withColumn("begin", F.coalesce(F.lag("cut").over(by_doc), F.lit(0)))
    in_step = F.min((F.col("k") == F.col("cuts") - 1) | F.col("cut").isNotNull()).over(Window.partitionBy("uid"))
    piece = F.substring(F.col("chunk"), F.col("begin") - F.col("start") + 1, F.coalesce(F.col("cut") - F.col("begin"), F.length("chunk") + 1))
    whole = F.substring(F.col("chunk"), F.lit(1), F.when(F.col("k") == F.col("cuts") - 1, F.length("chunk")).otherwise(F.lead("start").over(by_doc) - F.col("start")))
    stitched = stitched.select("uid", "key", "k", in_step.alias("in_step"), piece.alias("piece"), whole.alias("part"))
    cut_well = stitched.filter("in_step").select("uid", "k", "key", F.col("piece").alias("text"))
    rest = stitched.filter("not in_step").groupBy("uid").agg(F.lit(0).alias("k"), F.first("key").alias("key"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("text"))
    pieces = cut_well.unionByName(rest).mapInArrow(lambda batches: encode_batches(batches, ranks_path, pattern, 3), f"uid long, k int, key {key}, ids array<int>")
    joined = pieces.groupBy("uid").agg(F.first("key").alias("key"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined.select("key", "ids").mapInArrow(finish, schema))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows (key, ids) to rows (key, raw binary)."""
    key = encoded.schema["key"].dataType.simpleString()

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([codec.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], names=["key", "raw"])

    return encoded.select("key", "ids").mapInArrow(run, f"key {key}, raw binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, **sizes) -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests of both."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def finish(batches):
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            counts, ids_hex, raw_hex = [], [], []
            for ids in (x.as_py() for x in batch.column("ids")):  # a row at a time: a long text's ids are large
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(b" ".join(map(codec.digits.__getitem__, ids))).hexdigest())
                raw_hex.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(docs, "doc_id", "text", ranks_path, pattern, finish=finish, finish_schema=f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string", **sizes)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())
