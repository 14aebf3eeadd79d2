"""WARC files as a PySpark data source, for reading and writing.

    warc.register(spark)
    spark.read.format("warc").load(path).where("warc_type = 'response'")

Planning lists the files, largest first, and packs them into partitions of about
`partition_bytes`.  The writer leaves an index beside each file of where records
begin, one entry in INDEX_BYTES or so; a larger file that has one is split at
its entries, others are read whole.  Predicates on the record's headers are taken over from
Catalyst; a reader parses a record's header block first, and where a predicate
fails the block after it isn't decoded: in plain files it is sought past, in
compressed ones inflated to nowhere.  `option("payload", "false")` leaves all
payloads out.  A record or compressed member that ends early, or a record
without a length, fails the read, unless `option("mode", "permissive")` ends
that file there.

What a header line can't carry (line breaks, white space at either end) is
written once more, as base64, and a null payload is marked, so every row comes
back as it was.  A path without a scheme is taken for a local one; `read` and
`write` give it the scheme of Spark's default file system.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, position long"
ARROW = pa.schema(
    [
        *((n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "warc_date", "content_type")),
        ("content_length", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("http_status", pa.int32()),
        ("http_headers", pa.map_(pa.string(), pa.string())),
        ("payload", pa.binary()),
        ("file", pa.string()),
        ("position", pa.int64()),
    ]
)
#: Column of each header that has one.
NAMED = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
HEADER_COLUMNS = (*NAMED, "content_length")
#: Headers beside the named ones: the exact value in base64, and a payload that is null.
EXACT, NO_PAYLOAD = "x-lodestone-exact-", "x-lodestone-null-payload"
CHUNK = 1 << 16
#: Bytes of a file between entries of its index.
INDEX_BYTES = 4 << 20
BATCH_BYTES = 8 << 20
SUFFIXES = (".warc", ".warc.gz")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Files(InputPartition):
    """(path, size of the file, first byte, its place once inflated, place to stop at or None)"""

    files: list[tuple[str, int, int, int, int | None]]


class Source:
    """Bytes of a WARC file, inflated where it is compressed, read forward."""

    def __init__(self, fs: pafs.FileSystem, path: str, size: int, first: int = 0, position: int = 0):
        self.raw = fs.open_input_file(path)
        self.packed = self.raw.read(2) == b"\x1f\x8b"
        self.raw.seek(first)
        self.size, self.buffer, self.position, self.start = size, b"", position, position
        self.inflate = zlib.decompressobj(31) if self.packed else None
        self.begun = False

    def _more(self) -> bool:
        if not self.packed:
            got = self.raw.read(CHUNK)
            self.buffer += got
            return bool(got)
        while True:
            rest = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            got = rest or self.raw.read(CHUNK)
            if not got:
                if self.begun:
                    raise EOFError("a compressed member ends early")
                return False
            out = self.inflate.decompress(got)
            self.begun = not self.inflate.eof
            if out:
                self.buffer += out
                return True

    def header(self, stop: int | None = None) -> bytes | None:
        """The next header block; None at the end of the file, or where a record begins at `stop` or beyond."""
        while True:
            blank = len(self.buffer) - len(self.buffer.lstrip(b"\r\n"))
            self.buffer, self.position = self.buffer[blank:], self.position + blank
            if self.buffer or not self._more():
                break
        if not self.buffer or stop is not None and self.position >= stop:
            return None
        self.start = self.position
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise EOFError("a record's header ends early")
        out, self.buffer = self.buffer[:end], self.buffer[end + 4 :]
        self.position += end + 4
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise EOFError("a record's block ends early")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        self.position += n
        return whole[:n]

    def skip(self, n: int) -> None:
        self.position += n
        if not self.packed and n > len(self.buffer):
            to = self.raw.tell() + n - len(self.buffer)
            if to > self.size:
                raise EOFError("a record's block ends early")
            self.raw.seek(to)
            self.buffer = b""
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self._more():
                raise EOFError("a record's block ends early")
        self.buffer = self.buffer[n:]


def parse_headers(block: bytes) -> tuple[str, dict[str, str]]:
    """First line, and headers by lower-case name; a line that begins with white space goes on with the one before, of a repeated header the values are joined by ', '."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return lines[0], out


def _test(f: Filter, row: dict) -> bool:
    """SQL's three values as two: null fails, under Not as well."""
    if isinstance(f, Not):
        inner = f.child
        return row.get(inner.attribute[0]) is not None and not _test(inner, row)
    v = row.get(f.attribute[0])
    if isinstance(f, IsNull):
        return v is None
    if v is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    w = f.value
    tests = {EqualTo: lambda: v == w, In: lambda: v in w, StringStartsWith: lambda: v.startswith(w), StringEndsWith: lambda: v.endswith(w), StringContains: lambda: w in v, GreaterThan: lambda: v > w, GreaterThanOrEqual: lambda: v >= w, LessThan: lambda: v < w, LessThanOrEqual: lambda: v <= w}
    return tests[type(f)]()


_SIMPLE = (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
_ORDER = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def pushable(f: Filter) -> bool:
    """Predicates on header columns; of strings no order, since Python's isn't that of UTF-8 bytes; not In with a null in it."""
    if isinstance(f, Not):
        return isinstance(f.child, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and pushable(f.child)
    if getattr(f, "attribute", None) is None or len(f.attribute) != 1 or f.attribute[0] not in HEADER_COLUMNS:
        return False
    if isinstance(f, In):
        return all(x is not None for x in f.value)
    if isinstance(f, EqualTo):
        return f.value is not None
    return isinstance(f, _SIMPLE) or (isinstance(f, _ORDER) and f.attribute[0] == "content_length" and f.value is not None)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.permissive = str(options.get("mode", "failfast")).lower() == "permissive"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(SUFFIXES) and not os.path.basename(x.path).startswith((".", "_"))]
        out: list[Files] = []
        size = self.partition_bytes
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if not x.size:
                continue
            if not out or size + x.size > self.partition_bytes:
                out.append(Files([]))
                size = 0
            marks = self._index(fs, x) if x.size > self.partition_bytes else []
            if marks:
                ends = [m[1] for m in marks[1:]] + [None]
                out[-1:] = [Files([(x.path, x.size, first, place, end)]) for (first, place), end in zip(marks, ends)]
                size = self.partition_bytes
                continue
            out[-1].files.append((x.path, x.size, 0, 0, None))
            size += x.size
        return out

    def _index(self, fs: pafs.FileSystem, file: pafs.FileInfo) -> list[tuple[int, int]]:
        """Where parts of about partition_bytes begin, in the file and inflated; empty without an index that fits the file."""
        folder, name = os.path.split(file.path)
        at = f"{folder}/_{name}.index"
        if fs.get_file_info(at).type != pafs.FileType.File:
            return []
        with fs.open_input_stream(at) as f:
            found = json.loads(f.read())
        if found["size"] != file.size:
            return []
        marks: list[tuple[int, int]] = []
        for first, place in found["marks"]:
            if not marks or first - marks[-1][0] >= self.partition_bytes:
                marks.append((first, place))
        return marks

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if not partition or not getattr(partition, "files", None):
            return
        fs, _ = _filesystem(self.path)
        rows: list[dict] = []
        held = 0
        for part in partition.files:
            for row in self._records(fs, *part):
                rows.append(row)
                held += len(row["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    @staticmethod
    def _exact(headers: dict[str, str], name: str) -> str | None:
        whole = headers.pop(EXACT + name, None)
        if whole is not None:
            headers[name] = base64.b64decode(whole).decode("utf-8")
        return headers.get(name)

    def _records(self, fs: pafs.FileSystem, path: str, size: int, first: int = 0, place: int = 0, stop: int | None = None) -> Iterator[dict]:
        source = Source(fs, path, size, first, place)
        try:
            while True:
                try:
                    block = source.header(stop)
                    if block is None:
                        return
                    version, headers = parse_headers(block)
                    if not version.startswith("WARC/"):
                        raise ValueError(f"{path}: no record at byte {source.start}")
                    row = {c: self._exact(headers, h) for c, h in NAMED.items()}
                    nothing = headers.pop(NO_PAYLOAD, None)
                    row["content_length"] = n = int(headers["content-length"])
                    if n < 0:
                        raise ValueError(f"{path}: a negative length at byte {source.start}")
                    row |= {"headers": list(headers.items()), "http_status": None, "http_headers": None, "payload": None, "file": path, "position": source.start}
                    if not all(_test(f, row) for f in self.filters):
                        source.skip(n)
                        continue
                    http = (row["content_type"] or "").startswith("application/http")
                    if not self.payload and not http:
                        source.skip(n)
                    else:
                        body = source.take(n)
                        if http:
                            head, _, body = body.partition(b"\r\n\r\n")
                            first, fields = parse_headers(head)
                            code = first.split(" ")[1:2]
                            row["http_status"] = int(code[0]) if first.startswith("HTTP/") and code and code[0].isdigit() else None
                            row["http_headers"] = list(fields.items())
                        row["payload"] = body if self.payload and nothing is None else None
                except (ValueError, KeyError, EOFError, zlib.error) as e:
                    if self.permissive:
                        return
                    raise ValueError(f"{path}: broken record at byte {source.start}: {e!r}") from e
                yield row
        finally:
            source.raw.close()


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int

    def renamed(self) -> list[tuple[str, str]]:
        index = lambda p: "{}/_{}.index".format(*os.path.split(p))
        return [(index(self.temporary), index(self.final)), (self.temporary, self.final)]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one file under a hidden name; the commit gives those of successful tasks their names."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed = str(options.get("compression", "gzip")).lower() == "gzip"
        self.level = int(options.get("level", 1))
        self.run = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _filesystem(self.path)
        name = f"part-{self.run}-{uuid.uuid4().hex[:12]}.warc" + ".gz" * self.packed
        temporary, n = f"{path}/_temporary-{self.run}/{name}", 0
        fs.create_dir(os.path.dirname(temporary), recursive=True)
        marks, at, place = [], 0, 0
        with fs.open_output_stream(temporary, compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    if not marks or at - marks[-1][0] >= INDEX_BYTES:
                        marks.append((at, place))
                    whole = self.record(row)
                    packed = self._deflated(whole) if self.packed else whole
                    out.write(packed)
                    at, place, n = at + len(packed), place + len(whole), n + 1
        with fs.open_output_stream("{}/_{}.index".format(*os.path.split(temporary)), compression=None) as out:
            out.write(json.dumps({"size": at, "marks": marks}).encode())
        return Written(temporary, f"{path}/{name}", n)

    def record(self, row: dict) -> bytes:
        body = bytes(row.get("payload") or b"")
        if row.get("http_status") is not None:
            fields = dict(row.get("http_headers") or [])
            head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
            body = f"HTTP/1.1 {row['http_status']} \r\n{head}\r\n".encode() + body
        names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type"}
        lines = [f"{h}: {self._line(row[c])}" for c, h in names.items() if row.get(c) is not None]
        lines += [f"{EXACT}{h}: {base64.b64encode(row[c].encode()).decode()}" for c, h in names.items() if row.get(c) is not None and self._line(row[c]) != row[c]]
        lines += [f"{NO_PAYLOAD}: true"] * (row.get("payload") is None)
        lines += [f"{k}: {self._line(v)}" for k, v in (row.get("headers") or []) if k.lower() not in (*NAMED.values(), "content-length") and v is not None]
        return ("WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    def _deflated(self, whole: bytes) -> bytes:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        return z.compress(whole) + z.flush()

    @staticmethod
    def _line(value: str) -> str:
        return " ".join(str(value).splitlines()).strip()

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _filesystem(self.path)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if x.path.endswith(SUFFIXES)] if self.overwrite else []
        for m in messages:
            if m is not None and m.records:
                for was, now in m.renamed():
                    fs.move(was, now)
        for p in old:
            fs.delete_file(p)
            index = "{}/_{}.index".format(*os.path.split(p))
            if fs.get_file_info(index).type == pafs.FileType.File:
                fs.delete_file(index)
        self._clean(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_filesystem(self.path))

    def _clean(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/_temporary-{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/_temporary-{self.run}")
        fs.create_dir(path, recursive=True)


class WarcDataSource(DataSource):
    """Columns as in SCHEMA.  A missing header is null; http_* are null but for application/http blocks, whose payload is the body.

    Repeated records are all returned; an empty file or folder gives no rows.
    Written are warc_type, record_id, target_uri, warc_date, content_type,
    headers, http_status, http_headers and payload, as far as the data has
    them; null ones are left out, and come back as null.  In `headers` a value
    loses line breaks and white space at its ends.  Other columns, of whatever
    name, are ignored.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `warc` known and lets Spark hand predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme of Spark's default file system, where it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records below `path`, in partitions of spark.sql.files.maxPartitionBytes unless `partition_bytes` says otherwise."""
    register(spark)
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return spark.read.format("warc").options(**({"partition_bytes": size} | options)).load(qualified(spark, path))


def write(records: DataFrame, path: str, mode: str = "append", **options) -> None:
    """`records` as WARC files below `path`, one a partition."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode(mode).save(qualified(records.sparkSession, path))
