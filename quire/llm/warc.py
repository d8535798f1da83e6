"""WARC archives: write whole-file gzip, normalise to one member a record with an offset index, read back.

``write`` gives each partition of pages one ``.warc.gz`` that is a single gzip stream with every payload in it,
as some crawlers leave them, and tells each record's place and digest. Which records repeat a payload is found on
those places and digests alone. ``normalise`` inflates each stream once, rewrites every record as its own gzip
member, a repeated one as a revisit, and writes a sidecar index (``.idx``: file, offset, length, record id, type).
``read`` seeks by the index. Payloads never pass a shuffle.
Every file is made under a name of its own attempt or renamed when whole, so that a task that runs again does no harm. Files live in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import removed, scratch, split_join, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 18
#: Bytes of archive that a reading task has, at most about.
READ = 64 << 20
INDEX = "file string, offset long, length long, page_id long, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def head(fields: dict[str, str], size: int, refers_to: int | None = None, payload: bytes = b"") -> bytes:
    """A record by its fields: a response, or a revisit, which keeps the HTTP head alone. size: bytes of the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {fields['warc-record-id']}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {fields['warc-payload-digest']}"]
    if "warc-target-uri" in fields:
        lines.append("WARC-Target-URI: " + fields["warc-target-uri"])
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record of a page, or a revisit of another page's record."""
    fields = {"warc-record-id": f"<urn:page:{'' if page_id is None else page_id}>", "warc-payload-digest": f"sha1:{digest}"}
    if url is not None:
        fields["warc-target-uri"] = url.replace("\r", "%0D").replace("\n", "%0A")
    return head(fields, len(payload), refers_to, b"" if refers_to is not None else payload)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    at = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:at].decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, data[at + 4 : at + 4 + int(fields["content-length"])]


def _page(fields: dict[str, str], name: str) -> int | None:
    got = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


def write(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """One monolithic .warc.gz for each partition, all records responses; returns file, place (from 0), page_id, digest of each record."""
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        # the name is this attempt's own: of a task that runs twice only the rows of one are kept, and they name its file
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        n, out, gz = 0, None, zlib.compressobj(level, zlib.DEFLATED, 31)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                for r in rows:
                    out.write(gz.compress(record(r["page_id"], r["url"], r["payload"], base32_sha1(r["payload"]), None)))
                digests = [hashlib.sha256(r["payload"]).digest() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(n, n + len(rows)), pa.int64()), pa.array([r["page_id"] for r in rows], pa.int64()), pa.array(digests, pa.binary())], names=["file", "place", "page_id", "digest"])
                n += len(rows)
        if out:
            out.write(gz.flush())
            out.close()

    return stored(kept.mapInArrow(run, "file string, place long, page_id long, digest binary"), "warc-places")


def repeats(places: DataFrame) -> DataFrame:
    """file, place, refers_to of every record that revisits another: of equal payloads that of the largest page_id is the response. A common payload's records are dealt out."""
    top = stored(places.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")), "warc-payloads")
    # a payload that stands once, or once for each null, has nothing to refer to
    again = top.where("n > 1 and top is not null")
    both = split_join(places, again, ["digest"], "place", places.count())
    return both.where("page_id is null or page_id != top").select("file", "place", F.col("top").alias("refers_to"))


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, chunk by chunk."""
    z = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield z.decompress(data)
            data = b""
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (without the two line ends after them) from a stream cut anywhere."""
    held, chunks = bytearray(), iter(chunks)

    def more() -> bool:
        got = next(chunks, None)
        if got is not None:
            held.extend(got)
        return got is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends inside a record head")
                return
        length = next(int(x.split(b":", 1)[1]) for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
        size = at + 4 + length
        while len(held) < size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(held[:size])
        del held[: size + 4]


def revisit(data: bytes, refers_to: int) -> bytes:
    """The revisit record of a response record: its heads are kept, its payload is not."""
    fields, block = parsed(data)
    size = int(block.partition(b"\r\n\r\n")[0].rpartition(b"Content-Length: ")[2])
    return head(fields, size, refers_to).removesuffix(b"\r\n\r\n")


def normalise(places: DataFrame, again: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """Each monolithic archive as an archive of one member a record, with its sidecar index; returns file, n_records, n_bytes.

    A task reads whole archives, each once, beside the list of their repeated records in order.
    """
    files = places.select("file").distinct().select("file", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("refers_to"))
    number = files.count()
    work = files.unionByName(again).repartition(max(1, number), "file").sortWithinPartitions("file", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        _, old = pafs.FileSystem.from_uri(source)
        fs.create_dir(root, recursive=True)
        rows = ((f, p, r) for b in batches for f, p, r in zip(*(x.to_pylist() for x in b.columns)))
        row = next(rows, None)
        while row:
            name, n, at = row[0], 0, 0
            row = next(rows, None)
            made = f"{root}/.{name}-{uuid.uuid4().hex}"
            with fs.open_input_stream(f"{old}/{name}", compression=None) as src, fs.open_output_stream(made, compression=None) as out, fs.open_output_stream(f"{made}.idx", compression=None) as index:
                for data in split_records(inflated(src)):
                    if row and row[0] == name and row[1] == n:
                        data, row = revisit(data, row[2]), next(rows, None)
                    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = gz.compress(data + b"\r\n\r\n") + gz.flush()
                    out.write(member)
                    fields, _ = parsed(data)
                    page = _page(fields, "warc-record-id")
                    index.write(f"{name}\t{at}\t{len(member)}\t{'' if page is None else page}\t{fields['warc-type']}\n".encode())
                    at += len(member)
                    n += 1
            fs.move(made, f"{root}/{name}")
            fs.move(f"{made}.idx", f"{root}/{name.removesuffix('.warc.gz')}.idx")
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([at], pa.int64())})

    return stored(work.mapInArrow(run, "file string, n_records long, n_bytes long"), "warc-members")


def read(spark: SparkSession, folder: str, n_bytes: int) -> DataFrame:
    """Every record of the archives (n_bytes in all), found by the index: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    The index is dealt so that a task has about READ bytes of neighbouring records, however many lines they take.

    A response's payload is hashed again and held against its header; a revisit tells both values in its heads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, src = None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["file"] != name:
                    name, src = x["file"], fs.open_input_file(f"{root}/{x['file']}")
                src.seek(x["offset"])
                fields, block = parsed(zlib.decompress(src.read(x["length"]), 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(head.rpartition(b"Content-Length: ")[2])
                refers = _page(fields, "warc-refers-to")
                if fields["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"record {fields['warc-record-id']} does not hold what its heads tell")
                url = fields.get("warc-target-uri")
                rows.append((_page(fields, "warc-record-id"), size, digest, fields["warc-type"], refers, url))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    index = spark.read.schema(INDEX).option("sep", "\t").csv(f"{folder}/*.idx")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // READ))
    return index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RESULT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes a record for every page, normalises the archives and reads them back.

    Of equal payloads (any length, the empty one too) the largest page_id is the response and all others
    revisit it. Null html: empty payload; null url: none. A repeated page_id with an equal payload gives
    two responses; a null page_id revisits, or is a response if no other has the payload. An empty table gives an
    empty one; other columns are left out.
    """
    spark = pages.sparkSession
    top = scratch(spark, "warc")
    places = write(pages, f"{top}/whole")
    if places.isEmpty():
        return spark.createDataFrame([], RESULT)
    made = normalise(places, repeats(places), f"{top}/whole", f"{top}/members")
    removed(spark, f"{top}/whole")
    return read(spark, f"{top}/members", made.agg(F.sum("n_bytes")).first()[0])
