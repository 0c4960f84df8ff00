"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of a file, scans it for the gzip magic, and
takes a place for a record's start only if the bytes there decode to a WARC header (compressed data holds the magic by
chance). A task owns the records that start inside its range and reads on past its end to finish the last one, so ranges
can be of any size and no index is needed.

Archives lie in the shared folder. They are written under a name of the attempt and renamed when complete; the list of
complete files is what the writing tasks return, so a lost or repeated task leaves no half or double archive behind.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import file_system, scratch, spill, table, text_bytes

MAGIC = b"\x1f\x8b\x08"
HEAD_BYTES = 1 << 16
LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 64 << 20


def clean(value) -> str:
    """A header value: no line breaks, which would end the header."""
    return " ".join(str(value).split())


def record(page_id, url, payload: bytes, digest: str, refers_to, level: int = 1) -> bytes:
    """A response or revisit record as one gzip member. A revisit's block is empty; its headers describe the full payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the header's length, or None if this is no whole WARC header."""
    if not raw.startswith(b"WARC/1."):
        return None
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return (fields, end + 4) if fields.get("Content-Length", "").isdigit() and "WARC-Type" in fields else None


def is_record(data) -> bool | None:
    """Whether these bytes begin a member that decodes to a WARC header; None if they end before the header does."""
    most = 2048
    while True:
        z = zlib.decompressobj(31)
        try:
            raw = z.decompress(data, most)
        except zlib.error:
            return False
        if parse_head(raw) is not None:
            return True
        if z.eof or not raw.startswith(b"WARC/1.") or b"\r\n\r\n" in raw:
            return False
        if len(raw) < most:
            return None
        most *= 4


def read_range(stream, start: int, end: int, size: int, step: int = 1 << 20, bite: int = 1 << 13):
    """Records (fields, block) whose first byte lies in [start, end) of a seekable stream of `size` bytes."""
    stream.seek(start)
    base, pos, buf = start, 0, b""

    def fill() -> bool:
        nonlocal buf, base, pos
        more = stream.read(min(step, size - base - len(buf))) if base + len(buf) < size else b""
        if more:
            buf, base, pos = buf[pos:] + more, base + pos, 0
        return bool(more)

    fill()
    while True:
        at = buf.find(MAGIC, pos)
        if at < 0:
            pos = max(pos, len(buf) - len(MAGIC) + 1)
            if base + pos >= end or not fill():
                return
            continue
        pos = at
        if base + pos >= end:
            return
        need, found = HEAD_BYTES, None
        while found is None:  # a header may be of any length
            while len(buf) - pos < need and fill():
                pass
            found = is_record(buf[pos : pos + need])
            if len(buf) - pos < need:
                break
            need *= 2
        if not found:
            pos += 1
            continue
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if pos == len(buf) and not fill():
                raise ValueError("an archive ends inside a record")
            part = buf[pos : pos + bite]
            out.append(z.decompress(part))
            pos += len(part)
        pos -= len(z.unused_data)
        raw = b"".join(out)
        fields, head = parse_head(raw)
        block = raw[head : head + int(fields["Content-Length"])]
        if len(block) != int(fields["Content-Length"]):
            raise ValueError("a record shorter than its Content-Length")
        yield fields, block


def write_archives(pages: DataFrame, level: int = 1, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record for each page (page_id, url, html); returns the table of archives: path, size, records.

    Of pages with equal payloads of at least least_payload bytes, the smallest page_id's is a response and the others
    revisit it. Null html is an empty payload. Repeated rows of the smallest page_id are all responses; rows with a null
    page_id revisit if a page of the same payload has an id. A table without url or html columns fails; other columns
    are not looked at.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    same = F.octet_length("html") >= least_payload
    # Copies are counted before anything is shuffled; a digest that many pages have is split by the skew join.
    firsts = rows.filter(same).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    known = rows.join(firsts, same & (rows.digest == firsts.d), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    root = scratch(spark, "warc")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, folder = file_system(root)
        context, made, out, size, n = TaskContext.get(), 0, None, 0, 0
        fs.create_dir(folder, recursive=True)

        def close():
            nonlocal out, size, n, made
            out.close()
            fs.move(f"{folder}/{name}.part", f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "size": [size], "records": [n]})
            out, size, n, made = None, 0, 0, made + 1
            return row

        for b in batches:
            for key, url, payload, digest, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if out is None:
                    name = f"{context.partitionId():06d}-{made:04d}-{context.taskAttemptId()}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}.part")
                data = record(key, url, payload, bytes(digest).hex(), first, level)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
        if out is not None:
            yield close()

    return spill(known.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInArrow(write, "path string, size long, records long"), "warc-list")


def read_archives(archives: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """Every record of archives (path, size): page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured anew and must have the digest that its header gives.
    """
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    # A stated number, which the coalescing of small partitions leaves alone: ranges are tiny as rows, not as work.
    n = archives.agg(F.sum(F.ceil(F.greatest(F.col("size"), F.lit(1)) / range_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(n), 100_000), "path", "start")

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs, inner = file_system(path)
                rows = []
                with fs.open_input_file(inner) as stream:
                    for f, block in read_range(stream, start, start + range_bytes, size):
                        digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "revisit"
                        length = int(f["X-Payload-Length"]) if revisit else len(block)
                        if not revisit and hashlib.sha256(block).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload that doesn't have its digest")
                        key, to = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
                        rows.append((None if key is None else int(key), f.get("WARC-Target-URI"), length, digest, f["WARC-Type"], None if to is None else int(to)))
                if rows:
                    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return ranges.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"))
    got = spill(read_archives(archives).drop("url"), "warc-rows")
    if got.count() != (archives.agg(F.sum("records")).first()[0] or 0):
        raise ValueError("other records were read than written")
    return got


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
  CASE WHEN f.first <> q.page_id AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> q.page_id AND payload_bytes >= 100 THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest
"""
