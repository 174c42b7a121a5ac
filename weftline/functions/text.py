"""Text functions. All are built-in expressions; positions are code points from 0, ranges are half-open."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is blanked before words are taken, and the character classes of words.
BRACKETS = r"\[[^\]]*\]"
SLASHES = r"/[^/]*/"
NOT_WORD = r"[^\p{L}\p{N}_]"
WHITE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
VIDEO_ID = "[0-9a-zA-Z_-]{11}"


def let(value: Column, body) -> Column:
    """``body`` of a value worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def blank(text: Column, pattern: str) -> Column:
    """Each match replaced by as many spaces as it has characters, so that positions stay."""
    outside = F.split(text, pattern, -1)
    inside = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.repeat(F.lit(" "), F.length(x)))
    return F.array_join(F.zip_with(outside, inside, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def stripped(text: Column) -> Column:
    """Text without white space at its ends, of any kind: Unicode's and the separators U+001C to U+001F."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def _bare(text: Column) -> Column:
    """Lower-case text, stripped, with brackets and slashes blank; texts without any are not taken apart."""
    blanked = lambda pattern: lambda x: F.when(F.contains(x, F.lit(pattern[1] if pattern[0] == "\\" else pattern[0])), blank(x, pattern)).otherwise(x)
    return F.lower(let(let(stripped(text), blanked(BRACKETS)), blanked(SLASHES)))


def spaced(text: Column) -> Column:
    """Lower-case text, stripped, in which everything but words is blank."""
    return F.regexp_replace(_bare(text), NOT_WORD, " ")


def prefix_sums(numbers: Column, block: int = 128) -> Column:
    """Of an array, the sum of the elements before each. Sums run within blocks, then over blocks, so that long arrays are not copied for each element."""

    def sums(a, first):
        step = lambda s, x: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + x).alias("sum"))
        return F.aggregate(a, F.struct(F.array().cast("array<bigint>").alias("out"), first.alias("sum")), step)

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / F.lit(block)).cast("int") - 1, F.lit(0))), lambda k: F.slice(a, k * block + 1, F.lit(block)))

    def joined(b):
        totals = sums(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + y)), F.lit(0).cast("bigint"))["out"]
        return F.flatten(F.zip_with(b, totals, lambda x, t: sums(x, t)["out"]))

    return let(let(numbers, cut), joined)


def _placed(texts: pa.Array) -> pa.Array:
    """Of texts whose words stand between spaces, the words with their places. The words of all texts of a batch are handled as one array."""
    parts = pc.split_pattern(texts, " ")
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(length + 1)])
    beg = before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets))
    there = length > 0
    kept = np.concatenate([[0], np.cumsum(there)])[offsets].astype(np.int32)
    rows = pa.StructArray.from_arrays([words.filter(pa.array(there)), pa.array(beg[there]), pa.array((beg + length)[there])], names=["word", "beg", "end"])
    return pa.ListArray.from_arrays(pa.array(kept), rows, mask=texts.is_null())


def word_offsets(text: Column) -> Column:
    """array<struct<word, beg, end>>: the words of ``spaced`` with their places in the stripped text; null for null."""

    @F.arrow_udf("array<struct<word:string,beg:bigint,end:bigint>>")
    def placed(x: pa.Array) -> pa.Array:
        return _placed(x)

    return placed(spaced(text))


#: Bytes of texts whose words are placed at once.
PLACED_BYTES = 1 << 20


def _slices(texts: pa.Array, most: int):
    """(first, number of texts) of stretches of a batch that hold some ``most`` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto - at
        at = upto


def placed_words(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, word, beg, end): the rows of ``word_offsets``. Texts of some ``PLACED_BYTES`` are taken apart at a time and given on at once, so a task holds the words of few texts."""
    rows = df.select(*keys, spaced(text).alias("__x"))

    def run(batches):
        for batch in batches:
            for at, n in _slices(batch.column("__x"), PLACED_BYTES):
                part = batch.slice(at, n)
                found = _placed(part.column("__x"))
                own = part.select(keys).take(pc.list_parent_indices(found))
                flat = found.flatten()
                yield pa.RecordBatch.from_arrays([*own.columns, *(flat.field(c) for c in ("word", "beg", "end"))], names=[*keys, "word", "beg", "end"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return rows.mapInArrow(run, f"{kinds}, word string, beg bigint, end bigint")


def words(text: Column) -> Column:
    """White-space separated words, by Unicode's white space."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def normalized(text: Column) -> Column:
    """Words of ``spaced`` joined by single spaces."""
    return F.trim(F.regexp_replace(_bare(text), NOT_WORD + "+", " "))


def bare_words(text: Column) -> Column:
    """Words with their non-word characters removed; a word of such characters alone stays as an empty one."""
    return F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, NOT_WORD, ""))


def ngrams(tokens: Column, n: int = 3, compat: bool = False) -> Column:
    """n-grams joined by spaces. ``compat`` leaves the last one out, as older scores of document matchers did."""
    count = F.greatest(F.size(tokens) - n + (0 if compat else 1), F.lit(0))
    grams = lambda x, i: F.concat_ws(" ", x, *(F.get(tokens, i + k) for k in range(1, n)))
    return F.when(tokens.isNotNull(), F.transform(F.slice(tokens, F.lit(1), count), grams)).otherwise(F.array().cast("array<string>"))


def word_at(text: Column, at: Column) -> Column:
    """Number of the word that holds or follows code point ``at``; the last word if none does."""

    def found(w):
        state = F.struct(F.lit(0).alias("end"), F.lit(-1).alias("hit"), F.lit(0).alias("i"))
        step = lambda s, x: F.struct((s["end"] + F.length(x) + 1).alias("end"), F.when((s["hit"] < 0) & (s["end"] + F.length(x) > at), s["i"]).otherwise(s["hit"]).alias("hit"), (s["i"] + 1).alias("i"))
        return F.aggregate(w, state, step, lambda s: F.when(s["hit"] >= 0, s["hit"]).otherwise(F.size(w) - 1))

    return let(words(text), found)


def video_id(name: Column) -> Column:
    """The last 11-character id in a name, or an empty string."""
    found = F.regexp_extract_all(name, F.lit(VIDEO_ID), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise("")


def segment_id(name: Column, number: Column) -> Column:
    return F.format_string("%s_seg_%04d", name, number)


def percent(share: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


def labels_of(text: Column, ids: Column, delimiter: int) -> Column:
    """Label numbers of a text's characters (``ids``: a map; space is the delimiter), between two delimiters."""
    inner = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c == " ", F.lit(delimiter)).otherwise(ids[c]))
    return F.concat(F.array(F.lit(delimiter)), inner, F.array(F.lit(delimiter)))


def error_bucket(rate: Column) -> Column:
    return F.when(rate < 0.01, "perfect").when(rate < 0.1, "good").when(rate < 0.5, "mediocre").when(rate < 1, "bad").otherwise("terrible")


def decibels(samples: Column) -> Column:
    """20 log10 of the root mean square; minus infinity for silence, null without samples."""
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples)
    return F.when(F.size(samples) <= 0, F.lit(None).cast("double")).when(square == 0, F.lit(float("-inf"))).otherwise(20 * F.log10(F.sqrt(square)))


def highlighted(text: Column, beg: Column, end: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with a range of its characters marked."""
    rest = F.substring(text, end + 1, F.length(text))
    return F.concat(F.substring(text, F.lit(1), beg), F.lit(before), F.substring(text, beg + 1, end - beg), F.lit(after), rest)


def frame_of(seconds: Column, rate: float) -> Column:
    """Frame or sample number of a time, cut off towards 0."""
    return (seconds * F.lit(rate)).cast("int")


def midpoint(start: Column, end: Column) -> Column:
    return (start + end) / 2


def first_beam(beams: Column) -> Column:
    """The best of a decoder's readings, which come best first; null without any."""
    return F.get(beams, F.lit(0))


def same_length(words: Column, times: Column) -> Column:
    """``words``, or an error where they are not as many as their times."""
    return F.when(F.size(words) == F.size(times), words).otherwise(F.raise_error(F.concat(F.lit("words without times: "), F.size(words).cast("string"), F.lit(" and "), F.size(times).cast("string"))))


def byte_range(header: Column, size: Column) -> Column:
    """struct<begin, end, status> of an HTTP Range header over ``size`` bytes, [begin, end): status 206 for a range that can be met, 416 for one that begins after the end, and 200 with everything where there is none."""
    first, last = (F.try_to_number(F.nullif(F.regexp_extract(header, r"^\s*bytes=(\d*)-(\d*)\s*$", k), F.lit("")), F.lit("9" * 18)).cast("bigint") for k in (1, 2))
    begin = F.when(first.isNotNull(), first).when(last.isNotNull(), F.greatest(size - last, F.lit(0)))
    end = F.when(first.isNotNull() & last.isNotNull(), F.least(last + 1, size)).otherwise(size)
    asked = begin.isNotNull()
    status = F.when(~asked, 200).when((begin >= size) | (end <= begin), 416).otherwise(206)
    return F.struct(F.coalesce(begin, F.lit(0)).cast("bigint").alias("begin"), F.when(status == 416, F.coalesce(begin, F.lit(0))).otherwise(end).cast("bigint").alias("end"), status.alias("status"))
