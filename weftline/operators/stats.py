"""Statistics of segments and recordings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import words

REFERENCE_ONLY, RECO_ONLY = "only in reference", "only in reco"


def file_statistics(segments: DataFrame, key: str) -> DataFrame:
    """Segments and words of each kind, and the share of wrong words among those of segments with errors, in percent. Insertions don't count there."""
    error = F.col("match_error")
    kinds = {"ref_only": (error.eqNullSafe(REFERENCE_ONLY), "text"), "reco_only": (error.eqNullSafe(RECO_ONLY), "reco"), "ok_match": (error.isNull() | ~error.isin(REFERENCE_ONLY, RECO_ONLY), "norm")}
    sums = []
    for name, (cond, column) in kinds.items():
        sums.append(F.sum(cond.cast("long")).alias(f"{name}_seg"))
        sums.append(F.sum(F.when(cond, F.size(words(F.coalesce(column, F.lit("")))).cast("long")).otherwise(F.lit(0))).alias(f"{name}_words"))
    num, corr = F.sum(F.col("errors.num").cast("long")), F.sum(F.col("errors.corr").cast("long"))
    wer = F.when(F.coalesce(num, F.lit(0)) > 0, F.round(100 * (num - corr) / num, 2)).otherwise(F.lit(0.0))
    return segments.groupBy(key).agg(*sums, wer.alias("overall_wer"))


def without_reference_only(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.col("match_error").eqNullSafe(REFERENCE_ONLY))


def with_dates(stats: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """Adds the date of each key, or an empty string."""
    return stats.join(dates.select(key, "date"), key, "left").withColumn("date", F.coalesce("date", F.lit("")))


def durations(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Count, mean, shortest and longest span of the rows of a key."""
    span = F.col(end) - F.col(start)
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(span).alias("mean"), F.min(span).alias("shortest"), F.max(span).alias("longest"))


def coverage(ranges: DataFrame, totals: DataFrame, key: str, beg: str, end: str, total: str) -> DataFrame:
    """(key, covered): the share of ``total`` that the ranges add up to."""
    sums = ranges.groupBy(key).agg(F.sum(F.col(end) - F.col(beg)).alias("__c"))
    return totals.join(sums, key, "left").select(key, (F.coalesce("__c", F.lit(0)) / F.col(total)).alias("covered"))


def total_length(df: DataFrame, length: Column | str) -> DataFrame:
    """One row: how many rows there are and what their lengths add up to (0 without any)."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total"))


#: Words whose n-grams are counted together before they are shuffled, and words for each bucket of n-grams.
COUNTED_WORDS = 1 << 21


def _counted(lists: pa.Array, n: int) -> tuple[pa.Array, np.ndarray]:
    """The different n-grams of arrays of words, in the order of their words, and how often each occurs."""
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    at = np.flatnonzero(np.arange(len(flat)) + n <= np.repeat(np.cumsum(lengths), lengths))
    if not len(at):
        return pa.array([], flat.type), np.zeros(0, np.int64)
    coded = flat.dictionary_encode(null_encoding="encode")
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    ids = rank[coded.indices.to_numpy(zero_copy_only=False)]
    code = ids[at]
    for k in range(1, n):
        if int(code.max() + 1) * len(rank) >= 1 << 63:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(rank) + ids[at + k]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    parts = [flat.take(pa.array(at[first] + k)) for k in range(n)]
    if flat.null_count:  # nothing joined is an empty text; Arrow would leave it out
        parts[0] = pc.if_else(pc.is_null(pc.coalesce(*parts)), pa.scalar("", flat.type), parts[0])
    return pc.binary_join_element_wise(*parts, pa.scalar(" ", flat.type), null_handling="skip"), counts


def _hashes(texts: pa.Array) -> np.ndarray:
    """A number of each text, of its bytes alone: sums of bytes times powers of an odd number, modulo 2^64, mixed."""
    begins = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())]).astype(np.int64)
    sizes = np.diff(begins)
    first = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + begins[-1]].astype(np.uint64) + np.uint64(1) if begins[-1] else np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(max(int(sizes.max(initial=0)), 1), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * powers[np.arange(len(data)) - np.repeat(begins[:-1], sizes)], dtype=np.uint64)])
    out = sums[begins[1:]] - sums[begins[:-1]]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out >> np.uint64(33)


def _blocks(lists: list[pa.Array], n: int, buckets: int) -> pa.RecordBatch:
    """(bucket, block): counted n-grams by the hash of their text, each bucket as one compressed Arrow stream."""
    grams, counts = _counted(pa.concat_arrays(lists), n)
    bucket = np.empty(len(grams), np.int32)
    for at in range(0, len(grams), 1 << 16):
        bucket[at : at + (1 << 16)] = _hashes(grams.slice(at, 1 << 16)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, grams, counts = bucket[order], grams.take(pa.array(order)), counts[order]
    sizes = pc.binary_length(grams).to_numpy()
    begins, text = np.concatenate([[0], np.cumsum(sizes)]), pa.py_buffer(b"") if not len(grams) else grams.buffers()[2]
    edges = np.unique([0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]).tolist()
    out = [_packed(text.slice(begins[lo], begins[hi] - begins[lo]), sizes[lo:hi], counts[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(out, pa.binary())], names=["bucket", "block"])


def _packed(text: pa.Buffer, sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """N-grams one after the other with their sizes and counts, compressed."""
    row = pa.RecordBatch.from_arrays([pa.array([text.to_pybytes()], pa.large_binary()), pa.array([sizes.astype("<u4").tobytes()], pa.large_binary()), pa.array([counts.astype("<i8").tobytes()], pa.large_binary())], names=["text", "sizes", "counts"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Buffer) -> pa.Table:
    row = pa.ipc.open_stream(block).read_next_batch()
    text, sizes, counts = (c[0].as_buffer() for c in row.columns)
    begins = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64))])
    grams = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), text)
    return pa.table({"gram": grams, "n": np.frombuffer(counts, "<i8")})


def ngram_counts(texts: DataFrame, tokens: str, n: int = 3, size: Column | None = None) -> DataFrame:
    """(gram, n): the counts that a language model is estimated from.

    Few n-grams occur twice, so rows of n-grams would be shuffled whole and partial counts held for nothing. Instead the n-grams of some ``COUNTED_WORDS`` words are counted, sorted and shuffled as
    compressed blocks, one for each bucket of hashes; a bucket's blocks are added up in one task. Buckets grow in number with the words, so none grows. ``size``: about how many words a row has, where that is known without taking texts apart.
    """
    words_ = int(texts.agg(F.coalesce(F.sum(F.size(tokens) if size is None else size), F.lit(0))).first()[0])
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words_ // COUNTED_WORDS))

    def blocks(batches):
        held, have = [], 0
        for batch in batches:
            lists = batch.column(0).cast(pa.large_list(pa.large_string()))
            upto = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(lists):
                end = min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COUNTED_WORDS - have, side="right")) + 1, len(lists))
                held.append(lists.slice(at, end - at))
                have += int(upto[end - 1] - (upto[at - 1] if at else 0))
                at = end
                if have >= COUNTED_WORDS:
                    yield _blocks(held, n, buckets)
                    held, have = [], 0
        if have:
            yield _blocks(held, n, buckets)

    def added(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_buffer()) for chunk in table.column("block").chunks for x in chunk]
        return pa.concat_tables(parts).group_by("gram", use_threads=False).aggregate([("n", "sum")]).select(["gram", "n_sum"]).rename_columns(["gram", "n"]).cast(pa.schema([("gram", pa.string()), ("n", pa.int64())]))

    counted = texts.select(F.col(tokens)).mapInArrow(blocks, "bucket int, block binary")
    return counted.groupBy("bucket").applyInArrow(added, "gram string, n long")


def unigram_list(texts: DataFrame, tokens: str) -> DataFrame:
    """(word, id): distinct words in order, numbered from 1; 0 is left for unknown ones."""
    from weftline.operators.sequence import ordered_ids

    return ordered_ids(texts.select(F.explode(tokens).alias("word")).distinct(), F.col("word"))


def encoded(words: DataFrame, vocabulary: DataFrame, unknown: int = 0) -> DataFrame:
    """``words`` (with a column word) with the id of each word, or ``unknown``."""
    return words.join(vocabulary, "word", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def decoded(ids: DataFrame, vocabulary: DataFrame, unknown: str = "<unk>") -> DataFrame:
    """``ids`` (with a column id) with the word of each id, or ``unknown``."""
    return ids.join(vocabulary, "id", "left").withColumn("word", F.coalesce("word", F.lit(unknown)))
