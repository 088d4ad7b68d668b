"""WARC archives, index first: each record's file, offset, length, URL and digest, then coalesced byte-range reads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stateflux.llm.common import parts_for, salt, salt_mask, salts_in, scratch, slices, tidy, written
from stateflux.llm.store import NewFile, reader

#: Payloads shorter than this are always written in full.
LEAST = 1000
#: Two ranges with at most GAP bytes between them are read at once, up to READ bytes.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of records that one task reads, at least and at most (about).
SPAN = 1 << 22, 1 << 29
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_HOLDS, _NULL = 0x5374617465466C75 << 64, 0x5374617465466C78 << 64


def record_id(page_id: int | None) -> str:
    return f"<{uuid.UUID(int=_NULL if page_id is None else _HOLDS | page_id & (1 << 64) - 1).urn}>"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>")).int
    if number == _NULL:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP head, with the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parsed(member: bytes) -> dict:
    """The row a record says; the payload of a response is held against its digest."""
    from urllib.parse import unquote

    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    block = rest[: int(fields["content-length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b": ", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")))
    digest, revisit = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
    return {
        "page_id": page_of(fields["warc-record-id"]), "url": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "record_type": fields["warc-type"],
        "refers_to": page_of(fields["warc-refers-to"]) if revisit else None, "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for every row below ``folder`` and returns the index.

    Of rows with equal payloads of LEAST bytes or more, the one with the largest
    id is the response and the others revisit it. Equal means the same SHA-256
    and length. Groups are summed in each task before they are shuffled; rows
    meet their group on (digest, salt), so a payload that a third of all rows
    share is written by many tasks. Each task writes a file of its own and
    returns its records' places; a task that is run again writes another file,
    and only the places of the one that counts are in the index.

    Null html is empty, a null URL is left out, a null id has a record id of its
    own kind and is the largest of a group only if it is alone there. Rows that
    repeat an id are records like others; all rows with a group's largest id are
    responses. Other columns are ignored; an empty table writes no file and
    gives no rows. A payload of any length is one record, held whole in a task.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("salt", salt("page_id"))
    rows = rows.withColumn("sum", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    groups = rows.where(F.col("size") >= LEAST).groupBy("sum", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask"))
    groups = groups.where("n > 1").select("sum", "size", "last", F.explode(salts_in("mask")).alias("salt"))
    dealt = rows.join(groups, ["sum", "size", "salt"], "left").select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "last")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in slices(batches):
            found: list[list] = [[] for _ in range(7)]
            for page, link, body, digest, last in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or NewFile(folder, ".warc.gz")
                revisit = last is not None and last != page
                data = record(page, link, body, digest, last if revisit else None, revisit, date)
                for col, value in zip(found, (page, link, out.uri, out.write(data), len(data), digest, "revisit" if revisit else "response")):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), *(pa.array(found[i], pa.string()) for i in (1, 2)), *(pa.array(found[i], pa.int64()) for i in (3, 4)), *(pa.array(found[i], pa.string()) for i in (5, 6))], [x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return dealt.mapInArrow(tidy(write), INDEX)


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the places in ``selected`` (rows of an index), read in order of place.

    Places are dealt out by ranges and sorted; neighbours with small gaps are one
    read. The number of ranges follows from the bytes that the selected records
    have, not from the index, which is small.
    """
    size = selected.agg(F.sum("length")).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, name = None, [], None

        def fetch() -> pa.RecordBatch:
            begin = held[0][0]
            data = at.read_at(max(o + n for o, n in held) - begin, begin)
            rows = [parsed(data[o - begin : o - begin + n]) for o, n in held]
            held.clear()
            kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
            if not with_payload:
                kinds = pa.schema(list(kinds)[:-1])
            return pa.RecordBatch.from_pylist(rows, kinds)

        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (file != name or offset > held[-1][0] + held[-1][1] + GAP or offset + length - held[0][0] > READ):
                    yield fetch()
                if file != name:
                    if at:
                        at.close()
                    name, at = file, reader(file)
                held.append((offset, length))
        if held:
            yield fetch()
        if at:
            at.close()

    places = selected.select("file", "offset", "length").repartitionByRange(parts_for(selected.sparkSession, size, *SPAN), "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(tidy(read), RECORDS if with_payload else RECORDS.rpartition(",")[0])


def archived(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every page written to archives in the shared folder and read back through the index."""
    index = written(write_archives(pages, scratch(pages.sparkSession, "warc")), "warc-index")
    return read_records(index, with_payload)
