"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by id: ranges of about equal payload bytes, from a sample of ids that a hash draws, fix the
shards, so the same rows always make the same files. A task writes a shard under temporary names, rolls to the next file once the compressed size passes
``roll_bytes``, renames each whole file, and returns its manifest line; a task that runs again writes the same bytes.
Only files in the manifest belong to an archive. Headers, lengths and digests are made from the payloads anew.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import ranges
from .runtime import hot_beyond, ready, removed, scratch, spread_join, written

SHARD_BYTES = 64 << 20  # payload bytes aimed at for a shard
ROLL_BYTES = 16 << 20  # compressed bytes after which a file ends; one record may go beyond
MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string, first_id long, last_id long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, intact boolean, record_id string, refers_to_record string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # of every record: the pages carry no time, and files must not depend on the clock


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(text: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in text.encode()).encode("latin-1").decode("utf-8")


def _name(page_id: int | None, url: str | None, digest: str, number: int) -> str:
    """A record's id: of its page and payload, and its number among the records that have both; without a page id the url tells pages apart."""
    page = f"page:{page_id}" if page_id is not None else f"url:{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}' + (f':{number}' if number else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, number: int = 0) -> bytes:
    """One WARC/1.1 record, the ``number``th of its page and payload. A revisit has the HTTP head of the full payload and no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = _digest(payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id, url, digest, number)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", _one_line(url))] if url is not None else []
    head += [("X-Page-ID", page_id)] if page_id is not None else []
    head += [("WARC-Refers-To", _name(refers_to, None, digest, 0)), ("X-Refers-To-Page-ID", refers_to), ("WARC-Profile", PROFILE)] if revisit else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, with its lengths and digests checked against what it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")))
    digest, revisit = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"] == "revisit"
    intact = version == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and field["WARC-Block-Digest"] == f"sha1:{_digest(block)}"
    intact = intact and (payload == b"" if revisit else len(payload) == full and digest == _digest(payload))
    number = lambda k: int(field[k]) if k in field else None
    return {
        "page_id": number("X-Page-ID"), "url": field.get("WARC-Target-URI"), "payload_bytes": full, "payload_digest": digest, "record_type": field["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"), "payload": None if revisit else payload, "intact": intact,
        "record_id": field["WARC-Record-ID"], "refers_to_record": field.get("WARC-Refers-To"),
    }


class _File:
    """A file under a temporary name that gets its own when it is whole."""

    def __init__(self, folder: str, shard: int, part: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.name = f"shard-{shard:05d}-{part:05d}.warc.gz"
        self.at, self.path = posixpath.join(root, "_temporary", f"{uuid.uuid4().hex}-{self.name}"), posixpath.join(root, self.name)
        self.fs.create_dir(posixpath.dirname(self.at), recursive=True)
        self.out, self.sha = self.fs.open_output_stream(self.at, compression=None), hashlib.sha256()
        self.line = {"file": self.name, "shard": shard, "part": part, "records": 0, "bytes": 0, "first_id": None, "last_id": None}

    def put(self, page_id: int | None, data: bytes) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member for each record, without a time
        data = squeeze.compress(data) + squeeze.flush()
        self.out.write(data)
        self.sha.update(data)
        first = self.line["first_id"] if self.line["records"] else page_id
        self.line |= {"records": self.line["records"] + 1, "bytes": self.line["bytes"] + len(data), "first_id": first, "last_id": page_id}

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.at, self.path)
        return self.line | {"sha256": self.sha.hexdigest()}


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard and id; notes (name and head, for an id's payloads that are revisits) come before the id's pages.

        Pages without an id are one id here: their notes come before all of them in a shard.
        """
        file, lines, noted, heads, page, seen = None, [], (), {}, (), {}
        for batch in batches:
            ids, urls, htmls, names, refers, shards = (batch.column(k) for k in range(6))
            for k in range(len(batch)):
                page_id, shard, name, html = ids[k].as_py(), shards[k].as_py(), names[k].as_py(), htmls[k]
                if name is not None:
                    if noted != (shard, page_id):
                        noted, heads = (shard, page_id), {}
                    heads[name] = refers[k].as_py()
                    continue
                if file and (file.line["shard"] != shard or file.line["bytes"] >= roll_bytes):
                    part = file.line["part"] + 1 if file.line["shard"] == shard else 0
                    lines.append(file.close())
                    file = _File(folder, shard, part)
                file = file or _File(folder, shard, 0)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                name, url = hashlib.sha1(payload).hexdigest(), urls[k].as_py()
                head = heads.get(name) if noted == (shard, page_id) else None
                if page != (page_id, None if page_id is not None else url):  # records of one page, or url, follow each other
                    page, seen = (page_id, None if page_id is not None else url), {}
                number = seen[name] = seen.get(name, -1) + 1
                file.put(page_id, record(page_id, url, payload, head, head is not None, number))
        if file:
            lines.append(file.close())
        schema = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
        yield pa.RecordBatch.from_pylist(lines, schema)

    return run


def _shard_of(pages: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """A shard number that rises with page_id and ``second``, and how many there are. Null ids come first, dealt by their rows' hashes."""
    first, second = F.coalesce("page_id", F.lit(-(1 << 63))), F.col("second")
    cut = ranges(pages, first, second, F.coalesce(F.octet_length("html"), F.lit(0)) + 500, shard_bytes)
    return cut.of(first, second), cut.n


def write_archive(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write (page_id, url, html) rows as .warc.gz files under ``folder``, a URI all executors reach; returns the manifest.

    Of rows whose payloads (html in UTF-8; null: empty) are equal and of at least ``min_revisit_bytes``, those with the
    least page_id are responses and the others revisits of it, rows with a null id too; if all of them have null ids, all
    are responses. Repeated rows are written each, under record ids of their own. Extra columns are ignored. The manifest is also written, to
    ``folder``/_manifest, once all files are whole.
    """
    spark = ready(pages.sparkSession)
    second = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html")).otherwise(F.lit(0)).alias("second")  # deals out pages without an id
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select("*", second)
    name = F.sha1(F.coalesce("html", F.lit("")))
    heads = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes).select("page_id", name.alias("name"), "second")
    # notes: the head, a payload's least id, of each page that has a later one or none; payloads themselves are shuffled once
    first = heads.groupBy("name").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null")
    first = written(first, "heads")
    most = first.agg(F.sum("n").alias("rows"), F.max("n").alias("n")).first()
    notes = spread_join(heads, first, "name", hot_beyond(most["rows"] or 0, most["n"] or 0)).where("page_id is null or page_id > head")
    notes = notes.select("page_id", "name", "head", "second").distinct()
    shard, n = _shard_of(pages, shard_bytes)
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", "url", "html", none.alias("name"), F.lit(None).cast("long").alias("head"), shard.alias("shard"))
    rows = rows.unionByName(notes.select("page_id", none.alias("url"), none.alias("html"), "name", "head", shard.alias("shard")))
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", F.col("name").isNull(), "url", "html")
    manifest = written(rows.mapInArrow(_write(folder, roll_bytes), MANIFEST), "manifest")
    removed(spark, first)
    manifest.coalesce(1).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, rows, held = content.as_buffer(), [], 0
            view = memoryview(data)
            while len(view):
                member = zlib.decompressobj(31)
                parts, chunk = [], 0
                while not member.eof:  # a member's end is found without copying what follows it again and again
                    parts.append(member.decompress(view[chunk : chunk + 65536]))
                    chunk += 65536
                    if chunk >= len(view) and not member.eof:
                        raise ValueError(f"{path}: cut off")
                view = view[min(chunk, len(view)) - len(member.unused_data) :]
                rows.append(parse(b"".join(parts)) | {"file": path.rsplit("/", 1)[1]})
                held += len(rows[-1]["payload"] or b"")
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, each with whether its lengths and digests are right. A revisit's payload is null."""
    files = ready(spark).read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest.select("file"), "file", "left_semi")
    return named.select("path", "content").mapInArrow(_read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archive(spark, folder, write_archive(pages, folder))
