"""Fill-in-the-middle texts: prefix, suffix and middle of a text under marks, cut between units, and the way back.

A unit is a run of ASCII letters or any other single code point. Units are counted in one pass over the
UTF-8 bytes, in blocks of ``BLOCK`` bytes; while it counts, the pass notes a checkpoint (byte offset, code-point offset) at every ``STEP``-th
unit. The cuts are drawn after the count is known: a cut is looked up among the checkpoints by binary search, then
fewer than ``STEP`` units are scanned again from there. So a text is read once, whatever its length, and the index is small beside it.

A document keeps its plain form if it is empty, holds one of the marks (its output could not be taken apart), or by chance; else it is
suffix-first (spm) by chance, or prefix-first (psm). All chance is taken from a hash of a seed and the id, so reruns and retried tasks agree.

Cases: null counts as empty and stays plain, with null output; a null id hashes as the empty string; rows of one id are cut by the same numbers; prefix, middle or suffix
may be empty; an empty table gives an empty result; further columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import slices, table

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_MARK = re.compile(b"|".join((PREFIX, SUFFIX, MIDDLE)))
_UNIT = re.compile(rb"[A-Za-z]+|[\x00-\x7f]|[\xc0-\xff][\x80-\xbf]*")
STEP = 64
BLOCK = 1 << 20
OUT = "infill"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Checkpoints:
    """Units of UTF-8 bytes, counted; every ``step``-th one's byte and code-point offset."""

    def __init__(self, raw: bytes, step: int = STEP, block: int = BLOCK):
        self.raw, self.step, self.units, self.points = raw, step, 0, 0
        offsets, points, letter_before = [], [], False
        whole = np.frombuffer(raw, np.uint8)
        for at in range(0, len(raw), block):
            part = whole[at : at + block]
            letter = _LETTER[part]
            begins = (part & 0xC0) != 0x80  # not a continuation byte
            heads = begins.copy()
            heads[1:] &= ~(letter[1:] & letter[:-1])
            heads[0] &= not (letter[0] and letter_before)
            found = np.flatnonzero(heads)
            kept = found[-self.units % step :: step]
            if len(kept):
                # code points before each checkpoint; only the parts between checkpoints are summed
                counts = np.add.reduceat(begins, kept) if len(kept) else []
                first = self.points + int(begins[: kept[0]].sum())
                offsets.append(kept + at)
                points.append(first + np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int64))
            self.units += len(found)
            self.points += int(begins.sum())
            letter_before = bool(letter[-1])
        self.offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
        self.point_offsets = np.concatenate(points) if points else np.zeros(0, np.int64)
        #: numbers of the units that checkpoints stand at
        self.numbers = range(0, self.units, step)

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which unit number ``unit`` begins; the end of the text for the number of units."""
        if unit >= self.units:
            return len(self.raw), self.points
        k = bisect_right(self.numbers, unit) - 1
        at, point = int(self.offsets[k]), int(self.point_offsets[k])
        for _ in range(unit - self.numbers[k]):
            found = _UNIT.match(self.raw, at)
            point += found.end() - at if found.end() - at > 1 and self.raw[at] < 128 else 1
            at = found.end()
        return at, point


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(raw: bytes, numbers: list[int], plain_percent: int = 10, spm_percent: int = 20, step: int = STEP) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and output."""
    index = Checkpoints(raw, step)
    a, b, c, d = numbers
    if not raw or _MARK.search(raw) or c % 100 >= 100 - plain_percent:
        return index.units, "plain", None, None, raw
    (first, first_point), (last, last_point) = map(index.cut, sorted((a % (index.units + 1), b % (index.units + 1))))
    prefix, middle, suffix = raw[:first], raw[first:last], raw[last:]
    if d % 100 < spm_percent:
        form, out = "spm", b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    else:
        form, out = "psm", b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return index.units, form, first_point, last_point - first_point, out


def restore(out: bytes, form: str) -> bytes:
    """The text of an output. A mark cannot come about where text and mark meet, as only its first character is ``<``."""
    if form == "plain":
        return out
    head, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not out.startswith(head):
        raise ValueError("an output without its first mark")
    one, rest = out[len(head) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _rows(batches, id_at: int, text_at: int, seed: int, plain_percent: int, spm_percent: int, step: int):
    for whole in batches:
        for batch in slices(whole, text_at):
            n, form, prefix, middle, out = [], [], [], [], []
            for doc_id, raw in zip(batch.column(id_at).to_pylist(), batch.column(text_at).cast(pa.large_binary()).to_pylist(), strict=True):
                for values, value in zip((n, form, prefix, middle, out), transform(raw or b"", draws(seed, doc_id), plain_percent, spm_percent, step), strict=True):
                    values.append(value)
                if raw is None:
                    out[-1] = None
            added = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(f"{OUT}_{x}" for x in ("units", "form", "prefix_chars", "middle_chars", "text"))])


def _restored(batches, text_at: int, form_at: int):
    for whole in batches:
        for batch in slices(whole, text_at):
            out = [None if raw is None else restore(raw, form) for raw, form in zip(batch.column(text_at).cast(pa.large_binary()).to_pylist(), batch.column(form_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], names=[*batch.schema.names, f"{OUT}_restored"])


def infill(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, step: int = STEP) -> DataFrame:
    """``docs`` with columns whose names begin with ``OUT``: units, form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and the transformed text."""
    schema = StructType([*docs.schema.fields])
    for name, kind in (("units", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("text", "string")):
        schema = schema.add(f"{OUT}_{name}", kind)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    return docs.mapInArrow(lambda batches: _rows(batches, id_at, text_at, seed, plain_percent, spm_percent, step), schema)


def restored(transformed: DataFrame, text_col: str = f"{OUT}_text", form_col: str = f"{OUT}_form") -> DataFrame:
    """``transformed`` with the original text, ``infill_restored``, taken from output and form alone."""
    schema = StructType([*transformed.schema.fields]).add(f"{OUT}_restored", "string")
    text_at, form_at = transformed.columns.index(text_col), transformed.columns.index(form_col)
    return transformed.mapInArrow(lambda batches: _restored(batches, text_at, form_at), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    columns = [F.col(f"{OUT}_{x}").alias(y) for x, y in (("units", "n"), ("form", "form"), ("prefix_chars", "prefix_chars"), ("middle_chars", "middle_chars"))]
    return restored(made).select("doc_id", *columns, sha(f"{OUT}_text").alias("output_sha256"), sha(f"{OUT}_restored").alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
