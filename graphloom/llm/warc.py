"""WARC archives of pages, and a two-level capture index over them.

Archives are WARC/1.1 with one gzip member for each record, written through Spark's text sink: a row is a run of
compressed records of about FILE_BYTES, and makes a file of its own; the line separator is an empty gzip member, so the
files are valid whatever file system holds them.  Of records with equal payloads of at least MIN_BYTES the one with the
smallest page id is a response, the others are revisits of it.

The index sorts captures by SURT key (reversed host, then the rest of the URL) into compressed blocks of ``lines``
captures.  The sparse directory has one line for each block: its first and last key, file, offset and length; above it
stands one line for each file of blocks, of which there are at most MOST_FILES and one for each writing task.  A lookup
searches the files by halves, then the blocks of a file, reads the range of one block (or of the few that a key spans),
and then the ranges of the records.  ``lookup`` and ``fetch`` do so for one URL, reading ranges only; ``find`` and
``records`` for a table of URLs, where keys meet the files that can hold them, a bounded file at a time.

Defined cases: null html is an empty payload; a null url is indexed under "-", and line ends in one are blanks; a null
page id sorts after every id; rows that repeat a page id are records of their own, and none of them revisits another; an
empty table gives empty archives; other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import NO_ID, dealt, hot_keys, materialize, new_path, table

MIN_BYTES, LINES, FILE_BYTES, MOST_FILES = 100, 2000, 8 << 20, 10_000
#: An empty gzip member, which ends every record.
END = gzip.compress(b"", 9, mtime=0)
CAPTURE = "surt string, page_id long, file string, offset long, length long, record_type string, payload_digest string, payload_bytes long, refers_to long, checked boolean"


def header(url: str | None) -> str:
    """A URL as a record's header holds it."""
    return re.sub(r"[\r\n]", " ", url or "").strip() or "-"


def surt(url: str | None) -> str:
    """Reversed host, port, path and query of a URL, lower-cased but for the path; line ends are blanks, as in a record."""
    url = header(url)
    m = re.match(r"(?i)(?:([a-z][a-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not m:
        return url
    host = re.sub(r"^www\d*\.", "", m[2].lower())
    port = "" if m[3] in (None, ":80", ":443") else m[3]
    return ",".join(reversed(host.split("."))) + port + ")" + (m[4] or "/")


def decided(pages: DataFrame) -> DataFrame:
    """page_id, id (null last), row, payload_digest, payload_bytes and, of revisits, refers_to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select(
        "page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes")
    )
    return materialize(seen, "payloads")


def revisits(seen: DataFrame) -> DataFrame:
    """id, payload_digest, first of the pages that revisit another's payload.  One row for each."""
    large = seen.where(F.col("payload_bytes") >= MIN_BYTES)
    first = large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = dealt(large, first.drop("n"), ["payload_digest"], hot_keys(first, ["payload_digest"], seen.count()), "id")
    return found.where("id != first").select("id", "payload_digest", "first").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record, compressed."""
    name = "none" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {header(url)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if first is not None:
        refers = "none" if first == NO_ID else first
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def write_members(rows: DataFrame, path: str) -> None:
    """Writes the only column of rows, runs of compressed members, as one file for each row."""
    rows.select(F.col(rows.columns[0]).cast("string")).write.option("lineSep", END.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def runs(members: Iterator[bytes], size: int) -> Iterator[pa.RecordBatch]:
    """Members joined to runs of about so many bytes, an empty member behind each."""
    held, length = [], 0
    for m in members:
        held += (m, END)
        length += len(m) + len(END)
        if length >= size:
            yield pa.RecordBatch.from_pydict({"run": [b"".join(held)]})
            held, length = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"run": [b"".join(held)]})


def write_archives(pages: DataFrame, path: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """WARC files of all pages; returns their folder."""
    path = path or new_path(pages.sparkSession, "warc")
    seen = decided(pages)
    again = materialize(revisits(seen), "revisits")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("url", html.alias("html"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), F.sha2(html, 256).alias("payload_digest"))
    rows = rows.join(again, ["id", "payload_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for i, u, h, d, f in zip(*(b.column(c) for c in ("id", "url", "html", "payload_digest", "first")), strict=True):
                    i = i.as_py()
                    yield record(None if i == NO_ID else i, u.as_py(), h.as_py().encode("utf-8", "surrogatepass"), d.as_py(), f.as_py())

        yield from runs(records(), file_bytes)

    write_members(rows.select("id", "url", "html", "payload_digest", "first").mapInArrow(run, "run binary"), path)
    return path


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    offset: int
    length: int


def parse(data: bytes, base: int = 0) -> Iterable[Record]:
    """The records of an archive or of a range of it that starts at a record."""
    for at, length, raw in members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {base + at}")
        headers = dict(x.split(": ", 1) for x in lines)
        yield Record(headers, rest[: int(headers["Content-Length"])], base + at, length)


def number(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(\d+|-\d+)>", urn or "")
    return int(found[1]) if found else None


FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
RECORD = "page_id long, surt string, record_type string, refers_to long, stated_digest string, stated_bytes long, digest string, bytes long, payload binary"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives, read back; checked: a response's payload has the digest it states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("file"), b.column("content"), strict=True):
                rows = []
                for r in parse(content.as_buffer().to_pybytes()):
                    h = r.headers
                    kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                    right = kind == "revisit" or hashlib.sha256(r.payload).hexdigest() == digest and str(len(r.payload)) == h["WARC-Payload-Length"]
                    rows.append((surt(h["WARC-Target-URI"]), number(h["WARC-Record-ID"]), name.as_py(), r.offset, r.length, kind, digest, int(h["WARC-Payload-Length"]), number(h.get("WARC-Refers-To")), right))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], FIELDS)

    return archive_files(spark, path).mapInArrow(run, CAPTURE)


DIRECTORY = "first string, last string, file string, offset long, length long"
FOUND = "key string, " + CAPTURE


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content of the files of a folder, each bounded by what one row of write_members holds."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")


def between(directory: list[tuple], key: str) -> Iterator[tuple]:
    """The entries (first, last, ...) of a sorted directory that can hold a key."""
    at = max(0, bisect.bisect_left(directory, (key,)) - 1)
    for entry in directory[at:]:
        if entry[0] > key:
            return
        if entry[1] >= key:
            yield entry


def few(ranges: pa.ListScalar, n: int = 64) -> Iterator[list[dict]]:
    """The ranges of a file, some at a time; converted once."""
    wanted = ranges.as_py()
    for i in range(0, len(wanted), n):
        yield wanted[i : i + n]


class CaptureIndex:
    """Sorted blocks of captures and their directory, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._files: list[tuple[str, str, str]] | None = None

    @classmethod
    def build(cls, archives: DataFrame, path: str | None = None, lines: int = LINES, blocks: int = 16) -> CaptureIndex:
        """Sorts captures by key over the cluster; each task writes its range as compressed blocks, so many in a file."""
        spark = archives.sparkSession
        path = path or new_path(spark, "captures")
        rows = materialize(archives, "captures_read")
        n = rows.count()
        blocks = max(blocks, -(-n // (MOST_FILES * lines)))
        ordered = rows.repartitionByRange(max(1, -(-n // (blocks * lines))), "surt", "page_id").sortWithinPartitions("surt", "page_id", "file", "offset")

        def block(rows: list[dict]) -> bytes:
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            return z.compress("".join(json.dumps([r[f] for f in FIELDS]) + "\n" for r in rows).encode()) + z.flush()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            made: list[bytes] = []
            for b in batches:
                held += b.to_pylist()
                while len(held) >= lines:
                    made.append(block(held[:lines]))
                    held = held[lines:]
                    if len(made) == blocks:
                        yield from runs(iter(made), 1 << 62)
                        made = []
            yield from runs(iter([*made, block(held)] if held else made), 1 << 62)

        write_members(ordered.mapInArrow(run, "run binary"), f"{path}/blocks")
        index = cls(spark, path)
        index.blocks().write.parquet(f"{path}/directory")
        return index

    def blocks(self) -> DataFrame:
        """The directory, read from the blocks themselves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, content in zip(b.column("file"), b.column("content"), strict=True):
                    for offset, length, raw in members(content.as_buffer().to_pybytes()):
                        lines = raw.decode().splitlines()
                        yield pa.RecordBatch.from_pydict({"first": [json.loads(lines[0])[0]], "last": [json.loads(lines[-1])[0]], "file": [name.as_py()], "offset": [offset], "length": [length]})

        return archive_files(self.spark, f"{self.path}/blocks").mapInArrow(run, DIRECTORY)

    def directory(self) -> DataFrame:
        """The sparse directory, one row for each block of captures."""
        return self.spark.read.schema(DIRECTORY).parquet(f"{self.path}/directory")

    def files(self) -> list[tuple[str, str, str]]:
        """The upper level: first and last key of each file of blocks, sorted."""
        if self._files is None:
            rows = self.directory().groupBy("file").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect()
            self._files = sorted((r["first"], r["last"], r["file"]) for r in rows)
        return self._files

    def find(self, urls: DataFrame) -> DataFrame:
        """key and its captures, for each distinct url of a table; urls that were not captured have none."""
        held = self.spark.sparkContext.broadcast(self.files())  # MOST_FILES lines, and one for each writing task

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                pairs = [(key, file) for key in {surt(u) for u in b.column("url").to_pylist()} for _, _, file in between(held.value, key)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["key", "file"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content, directory, keys in zip(b.column("content"), b.column("directory"), b.column("keys"), strict=True):
                    data = content.as_buffer()
                    lines = sorted(tuple(d.values()) for d in directory.as_py())
                    read: dict[int, list[list]] = {}
                    wanted: dict[int, set[str]] = {}
                    for key in keys.as_py():
                        for _, _, offset, length in between(lines, key):
                            wanted.setdefault(offset, set()).add(key)
                            read.setdefault(offset, length)
                    for offset, some in wanted.items():
                        raw = next(iter(members(data.slice(offset, read[offset]).to_pybytes())))[2]
                        found = [v for v in map(json.loads, raw.decode().splitlines()) if v[0] in some]
                        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in found], pa.string()), *(pa.array([v[i] for v in found], t) for i, t in enumerate(KINDS))], ["key", *FIELDS])

        pairs = urls.select("url").distinct().mapInArrow(route, "key string, file string").distinct().groupBy("file").agg(F.collect_list("key").alias("keys"))
        lines = self.directory().groupBy("file").agg(F.collect_list(F.struct("first", "last", "offset", "length")).alias("directory"))
        wanted = pairs.join(lines, "file")
        return archive_files(self.spark, f"{self.path}/blocks").join(wanted, "file").select("content", "directory", "keys").mapInArrow(search, FOUND)

    def records(self, captures: DataFrame, archives: str) -> DataFrame:
        """captures with what the ranges of their records hold: headers as they are there, payload, digest and length of the payload."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content, ranges in zip(b.column("content"), b.column("ranges"), strict=True):
                    data = content.as_buffer()
                    for part in few(ranges):
                        got = [next(iter(parse(data.slice(x["offset"], x["length"]).to_pybytes(), x["offset"]))) for x in part]
                        columns = [
                            ([x["page_id"] for x in part], pa.int64()), ([x["surt"] for x in part], pa.string()), ([r.headers["WARC-Type"] for r in got], pa.string()), ([number(r.headers.get("WARC-Refers-To")) for r in got], pa.int64()),
                            ([r.headers["WARC-Payload-Digest"].removeprefix("sha256:") for r in got], pa.string()), ([int(r.headers["WARC-Payload-Length"]) for r in got], pa.int64()),
                            ([hashlib.sha256(r.payload).hexdigest() for r in got], pa.string()), ([len(r.payload) for r in got], pa.int64()), ([r.payload for r in got], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [c.split()[0] for c in RECORD.split(", ")])

        ranges = captures.groupBy("file").agg(F.collect_list(F.struct("page_id", "surt", "offset", "length")).alias("ranges"))
        return archive_files(self.spark, archives).join(ranges, "file").select("content", "ranges").mapInArrow(read, RECORD)

    def entries(self) -> DataFrame:
        """All captures, decoded from the blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column("content"):
                    for _, _, raw in members(content.as_buffer().to_pybytes()):
                        values = [json.loads(x) for x in raw.decode().splitlines()]
                        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(KINDS)], FIELDS)

        return archive_files(self.spark, f"{self.path}/blocks").mapInArrow(run, CAPTURE)

    def lookup(self, url: str) -> list[dict]:
        """The captures of a URL: files and their blocks are searched by halves, then the blocks that can hold the key are read."""
        key, found = surt(url), []
        for _, _, file in between(self.files(), key):
            lines = sorted((r["first"], r["last"], r["offset"], r["length"]) for r in self.directory().where(F.col("file") == file).collect())
            for _, _, offset, length in between(lines, key):
                values = map(json.loads, next(iter(members(read_range(self.spark, file, offset, length))))[2].decode().splitlines())
                found += [dict(zip(FIELDS, v, strict=True)) for v in values if v[0] == key]
        return found

    def fetch(self, capture: dict) -> Record:
        """A record, by the range that its capture states."""
        return next(iter(parse(read_range(self.spark, capture["file"], capture["offset"], capture["length"]), capture["offset"])))


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members that aren't empty."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, end, raw = zlib.decompressobj(31), at, []
        while not z.eof and end < len(data):  # piece by piece: what stands behind the member is copied
            raw.append(z.decompress(view[end : end + 4096]))
            end = min(end + 4096, len(data))
        if not z.eof:
            raise ValueError(f"the member at {at} is cut off")
        end -= len(z.unused_data)
        if content := b"".join(raw):
            yield at, end - at, content
        at = end


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file, on any file system Spark knows, without reading what stands before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


def verified(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, surt, checked of fetched records (without payload).

    A response is checked by its payload; a revisit by the payload of the response it refers to, which is fetched too."""
    records = materialize(records.drop("payload"), "records")
    response = F.col("record_type") == "response"
    payloads = records.where(response).groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("target"), F.col("digest").alias("stated_digest")).agg(F.max("bytes").alias("found"))
    known = records.where(~response).groupBy(F.coalesce("refers_to", F.lit(NO_ID)).alias("target"), "stated_digest").agg(F.count("*").alias("n"))
    again = records.where(~response).withColumns({"target": F.coalesce("refers_to", F.lit(NO_ID)), "one": F.monotonically_increasing_id()})
    again = dealt(again, payloads, ["target", "stated_digest"], hot_keys(known, ["target", "stated_digest"], records.count()), "one", "left")
    columns = ["page_id", F.col("stated_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to", "surt"]
    own = (F.col("digest") == F.col("stated_digest")) & (F.col("bytes") == F.col("stated_bytes"))
    return records.where(response).select(*columns, own.alias("checked")).unionByName(again.select(*columns, F.coalesce(F.col("found") == F.col("stated_bytes"), F.lit(False)).alias("checked")))


def op2_warc_index(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and surt, checked) of every page: its URL is searched in
    the index, its record is read from the range that the index states."""
    pages = table(spark, sf_dir, "pages")
    path = write_archives(pages)
    index = CaptureIndex.build(captures(spark, path))
    return verified(index.records(index.find(pages), path))
