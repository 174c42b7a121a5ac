"""WARC archives compressed record by record with a dictionary of their own.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, itself compressed if that is shorter; then one
Zstandard frame for each WARC/1.1 record, the first of them a warcinfo record. The dictionary is trained on all records of its archive. Frames name their
sizes and end where their last block ends, so any record can be read by itself.

Each page is one record. Of equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others are revisit
records that name it, hold the HTTP head alone and carry length and digest of the full payload; shorter payloads are responses always. Payloads are the same
if their SHA-256 hashes are; the hashes are counted before they are shuffled and owners found are joined by ``counted_join``,
so a payload that a third of all pages share is nowhere gathered.

Each task writes archives of about ``ARCHIVE_BYTES`` of records straight to the target folder, which is shared, through pyarrow's file systems
(local paths, file:, hdfs:, s3:, gs:), each under a name of its own. What counts is the manifest, a table that Spark commits: files of lost or repeated
attempts are in the folder, but not in the manifest.

Cases: a null payload is an empty one; a null url is left out; null ids come after all others; of rows with equal ids and payloads one is the response and the others revisit it, so
nothing is lost; ids of any type are read back in that type; urls are percent-encoded where they hold white space or control characters; an empty table gives
no archives and an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import counted_join, discard, materialize, new_path, partitions, slices, table

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 6
#: Pages have no time of their own.
DATE = "1970-01-01T00:00:00Z"

#: Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "!"  # no quoted id holds it


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, row: int) -> str:
    return f"<urn:page:{NO_ID if page_id is None else quote(str(page_id), safe='')}:{row}>"


def page_of(record: str | None) -> str | None:
    """The id in a record's name, as text; None for a page without one."""
    name = record[len("<urn:page:") : record.rindex(":")] if record else NO_ID
    return None if name == NO_ID else unquote(name)


def record(kind: str, name: str, block: bytes, *fields: tuple[str, str | None]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"".join((b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"))


def page_record(page_id, row: int, url: str | None, payload: bytes, owner: tuple | None, date: str = DATE) -> bytes:
    """The response record of a page, or with ``owner`` (id, row) the revisit record that names the owner's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    at = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda x: quote(x.group()), url)
    block = http if owner else http + payload
    revisit = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*owner))] if owner else []
    fields = [("WARC-Date", date), ("WARC-Target-URI", at), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), *revisit, ("Content-Type", "application/http; msgtype=response")]
    return record("revisit" if owner else "response", record_id(page_id, row), block, *fields)


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary trained on the records; of too few or too short ones, their own first bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, records)) // 8)), records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def compress(records: list[bytes], name: str, date: str = DATE, level: int = LEVEL) -> bytes:
    """The bytes of an archive."""
    import zstandard

    own = dictionary(records)
    raw = own.as_bytes()
    small = zstandard.ZstdCompressor(level=19).compress(raw)
    held = small if len(small) < len(raw) else raw
    info = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"software: weftline\r\nformat: WARC File Format 1.1\r\n", ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"))
    each = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *(each.compress(x) for x in (info, *records))])


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends: its blocks name their sizes."""
    import zstandard

    checksum = raw[at + 4] & 4
    at += zstandard.frame_header_size(raw[at : at + 18])
    last = 0
    while not last:
        head = int.from_bytes(raw[at : at + 3], "little")
        last, kind = head & 1, head >> 1 & 3
        at += 3 + (1 if kind == 1 else head >> 3)  # of a repeated byte only one is there
    return at + (4 if checksum else 0)


def records(raw: bytes):
    """The records of an archive, one after the other."""
    import zstandard

    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("an archive without a dictionary frame")
    held = raw[8 : 8 + size]
    if struct.unpack_from("<I", held.ljust(4, b"\0"))[0] == FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    each = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    view, at = memoryview(raw), 8 + size
    while at < len(raw):
        end = frame_end(view, at)
        yield each.decompress(view[at:end])
        at = end


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record, which is checked against its length and digests."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ValueError(f"a broken record: {fields.get('WARC-Record-ID')}")
    return fields, block


def page_row(fields: dict[str, str], block: bytes) -> dict:
    """A page's record as a row."""
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    own, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != own):
        raise ValueError(f"a payload that differs from its digest: {fields['WARC-Record-ID']}")
    name, owner = fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
    return {"record_id": name, "page_id": page_of(name), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": own, "record_type": fields["WARC-Type"], "refers_record": owner, "refers_to": page_of(owner), "payload": None if revisit else payload}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _write(batches, path: str, size: int, date: str, level: int):
    store, folder = _store(path)
    held, held_bytes = [], 0

    def flush():
        name = f"pages-{uuid.uuid4().hex}.warc.zst"
        raw = compress(held, name, date, level)
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(raw)
        return pa.RecordBatch.from_pydict({"name": [name], "records": [len(held)], "raw_bytes": [held_bytes], "bytes": [len(raw)]})

    for whole in batches:
        for batch in slices(whole, 3):
            for page_id, row, url, payload, owner in zip(*(c.cast(pa.large_binary()).to_pylist() if k == 3 else c.to_pylist() for k, c in enumerate(batch.columns)), strict=True):
                held.append(page_record(page_id, row, url, payload or b"", owner and (owner["id"], owner["row"]), date))
                held_bytes += len(held[-1])
                if held_bytes >= size:
                    yield flush()
                    held, held_bytes = [], 0
    if held:
        yield flush()


def write_archives(pages: DataFrame, path: str, least: int = 0, payload_col: str = "html", id_col: str = "page_id", url_col: str = "url", archive_bytes: int = ARCHIVE_BYTES, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write archives of ``pages`` to the folder ``path``; the manifest (name, records, raw_bytes, bytes) has a row for each."""
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    c = {x: F.col(f"`{y}`") for x, y in (("id", id_col), ("url", url_col), ("payload", payload_col))}
    payload = F.coalesce(c["payload"].cast("binary"), F.lit(b""))
    # rows get their numbers once, in a table, so that all passes agree on them
    rows = materialize(pages.select(c["id"].alias("id"), F.monotonically_increasing_id().alias("row"), c["url"].alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("hash")), "warc-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("o")
    owners = rows.filter(F.octet_length("payload") >= least).groupBy("hash").agg(first, F.count("*").alias("n")).filter("n > 1")
    owners = materialize(owners.select("hash", F.struct("o.id", "o.row").alias("owner"), "n"), "warc-owners")
    told = counted_join(rows, owners, "hash")
    told = told.select("id", "row", "url", "payload", F.when(F.col("owner.row") != F.col("row"), F.col("owner")).alias("owner"))
    manifest = materialize(told.mapInArrow(lambda batches: _write(batches, path, archive_bytes, date, level), "name string, records long, raw_bytes long, bytes long"), "warc-manifest")
    discard(rows, owners)
    return manifest


def _read(batches, path: str, with_payload: bool, columns: list[str]):
    store, folder = _store(path)
    kinds = [(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in columns]
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_file(f"{folder}/{name}") as file:
                raw = file.read()
            rows, held = [], 0

            def flush(rows):
                return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

            for x in records(raw):
                fields, block = parsed(x)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                rows.append(page_row(fields, block))
                held += len(block)
                if not with_payload:
                    del rows[-1]["payload"]
                if len(rows) == 4096 or with_payload and held > 8 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def read_archives(manifest: DataFrame, path: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_record, refers_to, and with ``with_payload`` the payload, null for revisits): the pages in the archives that the manifest lists, checked against their digests."""
    columns = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_record", "refers_to", *["payload"] * with_payload]
    schema = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'binary' if c == 'payload' else 'string'}" for c in columns)
    # a manifest is small, but its rows stand for whole archives
    names = manifest.select("name").repartition(partitions(manifest.sparkSession))
    found = names.mapInArrow(lambda batches: _read(batches, path, with_payload, columns), schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolved(pages: DataFrame) -> DataFrame:
    """Pages read with their payloads, revisits with the payload of the response they name."""
    own = pages.filter("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("payload").alias("__owner"))
    wanted = pages.filter("refers_record IS NOT NULL").select("refers_record").distinct()
    own = own.join(wanted, "refers_record", "left_semi")
    return pages.join(own, "refers_record", "left").withColumn("payload", F.coalesce("payload", "__owner")).select(*pages.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), new_path(spark, "warc")
    manifest = write_archives(pages, path)
    return read_archives(manifest, path, pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT page_id, h, sha1(h) AS x, first_value(page_id) OVER w AS owner, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(h) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN owner END AS refers_to FROM o
"""
