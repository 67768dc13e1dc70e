"""Sharded WARC archives: a deterministic writer with manifests, and a reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajq.session import ship_package

from .common import hot_keys, materialise, scratch, shuffle_partitions

#: Written in records of no date of their own and never the clock's, so that a rewrite gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, records long, file_bytes long, file_sha1 string"
RECORDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def _record_id(*what: object) -> str:
    """Of a page's record: its id, payload digest and number among the rows that have both in common."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(what))}>"


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own. Line ends in values are percent-encoded; a header without a value is left out."""
    lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in headers if v is not None]
    text = "WARC/1.1\r\n" + "".join(lines) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without a time
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _escaped(page: object) -> str | None:
    """An id as a header's value: with its percent signs encoded, so that line ends can be too. None stays None."""
    return None if page is None else str(page).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _response(page: object, url: str | None, date: str, payload: bytes, digest: str, nth: int, refers_to: tuple | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", _record_id(page, digest, nth)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url or f"urn:page:{page}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{_b32(digest)}"),
        ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).hexdigest())}"),
        ("X-Page-Id", _escaped(page)),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to[0], digest, 0)),
            ("X-Refers-To-Page-Id", _escaped(refers_to[0])),
        ]
    return _member(headers, block)


class _Roller:
    """Writes records under a temporary name and moves a file to its final name when it is whole."""

    def __init__(self, fs: pafs.FileSystem, folder: str, roll_bytes: int):
        self.fs, self.folder, self.roll_bytes, self.part, self.n, self.out = fs, folder, roll_bytes, TaskContext.get().partitionId(), 0, None

    def write(self, member: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.n:05d}.warc.gz"
            self.temporary = f"{self.folder}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
            self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            yield self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        self.out, self.n = None, self.n + 1
        return self.name, self.records, self.size, self.sha.hexdigest()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, roll_bytes: int = 8 << 20, min_revisit: int = 1000) -> DataFrame:
    """Write one WARC record per row to `folder` (a URI that driver and executors share) and return the manifest.

    Rows are range-sorted by payload digest and descending id, so the first of equal payloads is the response and its
    neighbours revisit it; payloads under min_revisit bytes are all responses. A payload that outweighs a mean
    partition is dealt over several ranges, and its response's id is then looked up in a table of at most as many
    rows as there are partitions. Files roll once they hold roll_bytes compressed. Names and bytes depend only on the
    rows: a task that is run again writes the same files, each moved into place when whole. The manifest, written by
    Spark after all of them, is the commit: readers follow it and never list the folder.

    A null payload is empty; a null url becomes urn:page:ID; null ids rank last; of repeated rows the first is the
    response, and each has a record id of its own. date_col is a timestamp, DATE where it is null or not given. Other
    columns are not read, so their names can't clash. A payload is held whole, whatever its length. An empty table gives
    an empty manifest. What failed attempts left under temporary names is deleted once the manifest is written.
    """
    spark = pages.sparkSession
    ship_package(spark)
    parts = shuffle_partitions(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    utc = F.lit(None) if date_col is None else F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    date = F.coalesce(utc.cast("string"), F.lit(DATE))
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), date.alias("date"), payload.alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "large": F.octet_length("payload") >= min_revisit}
    )
    weights = keyed.where("large").select("digest", "page_id", (F.octet_length("payload") + 256).cast("long").alias("w"))
    hot = hot_keys(weights, "digest", parts, F.max("page_id").alias("top"))
    salt = F.when(~F.col("large"), F.pmod(F.xxhash64("page_id"), F.lit(parts))).when(F.col("n_salts").isNotNull(), F.pmod(F.xxhash64("page_id"), F.col("n_salts"))).otherwise(0)
    ranged = (
        keyed.join(F.broadcast(hot), "digest", "left")
        .withColumns({"salt": salt.cast("int"), "split": F.col("n_salts").isNotNull() & F.col("large")})
        .select("digest", "salt", "page_id", "url", "date", "payload", "large", "split", "top")
        .repartitionByRange(parts, "digest", "salt")
        .sortWithinPartitions("digest", "salt", F.col("page_id").desc_nulls_last(), "url", "date")
    )
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        roller, done, group, same, nth = _Roller(fs, path, roll_bytes), [], None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                page, refers_to = row["page_id"], None
                nth = nth + 1 if same == (row["digest"], page) else 0
                same = row["digest"], page
                if row["large"]:
                    if row["split"]:
                        first, head = page == row["top"] and nth == 0, row["top"]
                    else:
                        first = row["digest"] != group
                        head = page if first else head  # noqa: F821
                    refers_to = None if first else (head,)
                    group = row["digest"]
                done += roller.write(_response(page, row["url"], row["date"], row["payload"].encode(), row["digest"], nth, refers_to))
        if roller.out is not None:
            done.append(roller.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "records", "file_bytes", "file_sha1"])

    ranged.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    fs.delete_dir(f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            yield headers, f.read(int(headers["Content-Length"]))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per response or revisit record of the committed files: RECORDS. intact: block and payload digests hold."""
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in _records(stream):
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        intact = headers["WARC-Block-Digest"] == f"sha1:{_b32(hashlib.sha1(block).hexdigest())}"
                        length = int(headers["X-Payload-Length"])
                        if headers["WARC-Type"] == "response":
                            length, found = len(payload), hashlib.sha1(payload).hexdigest()
                            intact, digest = intact and found == digest, found
                        rows.append((_unescaped(headers.get("X-Page-Id")), length, digest, headers["WARC-Type"], _unescaped(headers.get("X-Refers-To-Page-Id")), intact))
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    return manifest.select("file").repartition(shuffle_partitions(spark)).mapInArrow(scan, RECORDS)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages to a new folder of the shared scratch space and read the archives back, ids in their own type."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write_archives(pages, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", id_col, **options)
    kind = dict(pages.dtypes)[id_col]
    back = read_archives(spark, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return materialise(back, "records").select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "intact")
