"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm.common import joined_by_hot_key, slices, written

#: Texts with at least so many bytes are stored once; further copies are revisit records.
MIN_REVISIT_BYTES = 0
CHUNK = 1 << 16
READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, number: int) -> str:
    """Id of the `number`th record of an archive; archives of one run have names of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def record(identity: str, date: str, page: dict) -> bytes:
    """One record as a gzip member; a page with `refers_to` is a revisit without the payload.

    A revisit names the address and date of the response that holds its payload.
    """

    def uri(value: str | None) -> str:  # header lines end at CR LF, so an address cannot hold them
        return (value or "").replace("\r", "%0D").replace("\n", "%0A")

    payload = page["html"].encode()
    revisit = page["refers_to"] is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {identity}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri(page['url'])}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(body)}",
        f"X-Page-ID: {'' if page['page_id'] is None else page['page_id']}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {uri(page['refers_to_url'])}",
            f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {page['refers_to']}",
        ]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packer.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time; a cut member raises EOFError."""
    pending = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = pending or stream.read(chunk)
            pending = b""
            if not data:
                if parts or unpacker.unconsumed_tail:
                    raise EOFError("the archive ends inside a record")
                return
            parts.append(unpacker.decompress(data))
            if not unpacker.eof and not parts[-1] and len(parts) == 1:
                parts = [b""]  # a member has begun, even if nothing came out of it yet
        pending = unpacker.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; ValueError for broken framing or a block that does not match its digest."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("content length does not match the record")
    if headers["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest does not match")
    return headers, block


def classified(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """`page_id, url, html, refers_to, refers_to_url`: of equal payloads the row with the largest page_id is kept.

    Rows that share both payload and that page_id are all responses; of their addresses the last
    in order is referred to. Only payloads that occur more than once are looked up, and pages stay
    where they are or are dealt by salt, so a page that half the table repeats is no hot key.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("h"))
    by_id = F.struct(F.col("page_id"), F.col("url"))
    copies = rows.groupBy("h").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"), F.max(F.octet_length("html")).alias("bytes"), F.max_by("url", by_id).alias("kept_url"))
    copies = written(copies.where((F.col("n") > 1) & (F.col("bytes") >= min_revisit_bytes)).select("h", "kept", "kept_url"), "copies")
    revisit = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    joined = joined_by_hot_key(rows, copies, "h", F.struct("page_id", "url"), "left")
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("kept")).alias("refers_to"), F.when(revisit, F.col("kept_url")).alias("refers_to_url"))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str | None = None) -> DataFrame:
    """Write an archive per task into `folder`, a URI that all executors share; returns their names and counts.

    A task writes under a name of its own and renames at the end, so a task that is run again, or
    twice at once, leaves one whole archive. Null html is an empty payload; pages that repeat a
    page_id, or have none, are a record each; an empty table gives no archive. `date` is the time
    of all records, now if not given.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = uri.replace("file:///", "file:/").replace("file:/", "file:///")

    def write(batches):
        files, base = fs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        temporary, final = f"{base}/.{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}.warc.gz"
        count, out = 0, None
        try:
            for batch in slices(batches, 64):
                for row in batch.to_pylist():
                    if out is None:
                        files.create_dir(base, recursive=True)
                        out = files.open_output_stream(temporary, compression=None)
                    out.write(record(record_id(final, count), date, row))
                    count += 1
        finally:
            if out is not None:
                out.close()
        if count:
            files.move(temporary, final)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([f"part-{part:06d}.warc.gz"]), pa.array([count], pa.int64())], names=["folder", "archive", "records"])

    made = classified(pages, min_revisit_bytes).mapInArrow(write, "folder string, archive string, records long")
    names = made.collect()  # a row per task
    return pages.sparkSession.createDataFrame(names, "folder string, archive string, records long")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives, each file read once from its start to its end by one task.

    Framing and digests are verified; a record that fails stops the job. Revisits carry the digest
    and the length of the payload they stand for.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, base = fs.FileSystem.from_uri(row["folder"])
                with files.open_input_stream(f"{base}/{row['archive']}", compression=None) as stream:
                    rows, count = [], 0
                    for raw in members(stream):
                        head, block = parse_record(raw)
                        revisit = head["warc-type"] == "revisit"
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (payload_digest(block) != digest or len(block) != int(head["x-payload-length"])):
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        rows.append({
                            "page_id": int(head["x-page-id"]) if head["x-page-id"] else None, "url": head["warc-target-uri"], "payload_bytes": int(head["x-payload-length"]), "payload_digest": digest,
                            "record_type": head["warc-type"], "refers_to": int(head["x-refers-to-page-id"]) if revisit else None, "payload": block if with_payload else None,
                        })
                        count += 1
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                if count != row["records"]:
                    raise ValueError(f"{row['archive']} has {count} records, {row['records']} were written")

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in READ_SCHEMA.split(", "))])
    found = archives.repartition(max(1, archives.count())).mapInArrow(read, READ_SCHEMA)
    return found if with_payload else found.drop("payload")
