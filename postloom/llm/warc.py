"""WARC archives: a deterministic sharded writer, and a reader.

Records are sorted by page id over ranges that depend on the pages only: their bounds are page ids
picked by a hash, so any cluster cuts the same files. A range is written as files that roll over when
their compressed size is reached; a record is a gzip member of its own, with headers and digests made
anew. Files are written under temporary names and become visible by a rename after the manifest, which
Spark commits as a table, names them: a lost or repeated task leaves files that nothing refers to.

Payloads that repeat are stored once; the others are revisit records that refer to the first.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import cut_lineage

# fixed values: names and formats of the public WARC 1.1 standard
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_KIND = "application/http;msgtype=response"

#: Payloads shorter than this are stored each.
LEAST_SHARED = 100


@dataclass(frozen=True)
class Layout:
    """How files are cut. ``range_bytes`` of payload make a range, with ``least_ranges`` in any case.

    Beyond ``most_ranges`` ranges grow, as the driver holds a bound for each; files do not.
    """

    range_bytes: int = 128 << 20
    least_ranges: int = 64
    most_ranges: int = 1 << 16
    #: Page ids picked for each range; one in so many is a bound.
    picked: int = 8
    #: A file is closed when its compressed size reaches this.
    file_bytes: int = 64 << 20
    date: str = "2000-01-01T00:00:00Z"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark resolves it to, so that archives and tables lie in one store.

    On a cluster a folder of the machine itself is refused unless it is named as such.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not full.startswith("file:"):
        return full
    if path.toUri().getScheme() is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of this machine; name one that all executors share")
    return "file:///" + full.removeprefix("file:").lstrip("/")


def _record_id(page_id: int | None, digest: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{number}')}>"


def record(kind: str, page_id, url, payload: bytes, digest: str, number: int, refers_to, refers_url, date: str) -> bytes:
    """One record, not compressed. A revisit has the HTTP head of its payload and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    clean = "".join(c if c.isprintable() else " " for c in url or "")
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest, number)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Type: {RESPONSE_KIND}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        seen = "".join(c if c.isprintable() else " " for c in refers_url or "")
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}",
            f"WARC-Refers-To-Target-URI: {seen}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    # no time and no name in the head, so that equal records are equal bytes
    return gzip.compress(data, compresslevel=6, mtime=0)


class _Roll:
    """Writes the records of one range to files that roll over by compressed size."""

    def __init__(self, store: fs.FileSystem, root: str, attempt: str, number: int, layout: Layout) -> None:
        self.store, self.root, self.attempt, self.number, self.layout = store, root, attempt, number, layout
        self.part, self.stream, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.name = f"part-{self.number:08d}-{self.part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.stream = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        member = _member(data)
        self.stream.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.layout.file_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((self.name, self.temporary, self.records, self.size, self.digest.hexdigest()))
            self.stream, self.part = None, self.part + 1


_MANIFEST = "file string, temporary string, records long, bytes long, sha256 string"


def _write_ranges(rows: DataFrame, folder: str, layout: Layout) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt, roll, last, facts = uuid.uuid4().hex, None, None, {}
        done: list[tuple] = []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if roll is None or roll.number != r.range:
                    if roll is not None:
                        roll.close()
                        done += roll.done
                    roll, last, facts = _Roll(store, root, attempt, r.range, layout), None, {}
                page = int(r.page_text) if r.page_text is not None else None
                if r.html is None:
                    # what is known of the page's payloads comes before the page
                    facts = {} if page != last else facts
                    facts[r.digest] = [int(r.refers_text) if r.refers_text is not None else None, r.refers_url, 0]
                    last = page
                    continue
                known = facts.get(r.digest) if page == last else None
                refers, seen_url, number = known or (None, None, 0)
                if known:
                    # rows repeated whole: the first is the response, the others revisit it
                    known[2] += 1
                revisit = refers is not None and (refers != page or number > 0)
                kind = "revisit" if revisit else "response"
                roll.add(record(kind, page, r.url, r.html, r.digest, number, refers, seen_url, layout.date))
        if roll is not None:
            roll.close()
            done += roll.done
        yield pd.DataFrame(done, columns=["file", "temporary", "records", "bytes", "sha256"])

    return rows.mapInPandas(run, _MANIFEST)


def write(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """Write a record for every row (``page_id``, ``url``, ``html``) below ``folder``; return the manifest.

    The manifest (``file``, ``temporary``, ``records``, ``bytes``, ``sha256``) lists the files that
    count. ``folder`` is one that all executors share, empty or not there. A null html is an empty
    payload and a null url an empty target. Of equal payloads of ``LEAST_SHARED`` bytes or more, the
    smallest page id is the response. Rows without an id are responses unless an id has their payload,
    rows repeated whole are a response and revisits of it. An empty table gives no files.
    """
    folder = qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    narrow = cut_lineage(rows.select("page_id", "url", "digest", "size"), "payloads")

    shared = narrow.where(F.col("size") >= LEAST_SHARED)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = (
        shared.groupBy("digest")
        .agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    )
    facts = shared.join(first, "digest").select("page_id", "digest", "refers_to", "refers_url").distinct()

    bounds = _bounds(narrow, layout)
    held = pages.sparkSession.sparkContext.broadcast(np.array(bounds, dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, ids.to_numpy(), side="right").astype(np.int32))

    # rows without an id have ranges of their own, so that many of them are not one range
    nameless = len(bounds) + 1 + F.pmod(F.xxhash64("digest"), F.lit(layout.least_ranges))
    place = F.when(F.col("page_id").isNull(), nameless.cast("int")).otherwise(range_of(F.coalesce("page_id", F.lit(0))))

    # ids go to the writer as text: a null would make them floats
    told = ["page_id", F.col("page_id").cast("string").alias("page_text"), "digest"]
    none = F.lit(None).cast("string")
    bodies = rows.select(*told, "url", "html", none.alias("refers_text"), none.alias("refers_url"))
    notes = facts.select(*told, F.col("refers_to").cast("string").alias("refers_text"), "refers_url")
    ranged = bodies.unionByName(notes, allowMissingColumns=True).withColumn("range", place)
    ordered = ranged.repartition("range").sortWithinPartitions(
        "range", "page_id", F.col("html").isNotNull(), "digest", "url"
    )
    manifest = _write_ranges(ordered.drop("page_id"), folder, layout)
    # the rows that this table holds are those of one attempt of each task
    manifest = cut_lineage(manifest, "manifest")
    return cut_lineage(_commit(manifest, folder), "manifest")


def _bounds(narrow: DataFrame, layout: Layout) -> list[int]:
    """First page ids of all ranges but the first; ids are picked by a hash, about ``picked`` for a range."""
    facts = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("page_id")).first()
    ranges = min(layout.most_ranges, max(layout.least_ranges, -(-facts[0] // layout.range_bytes)))
    share = min(1.0, ranges * layout.picked / max(1, facts[1]))
    limit = int(share * (1 << 30))
    chosen = narrow.where(
        F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id", F.lit("bound")), F.lit(1 << 30)) <= limit)
    )
    # ``most_ranges`` * ``picked`` numbers at most
    ids = sorted({row[0] for row in chosen.select("page_id").distinct().collect()})
    return ids[layout.picked :: layout.picked]


def _commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of the manifest their names; done again, it finds them there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                target = f"{root}/{row.file}"
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    store.move(f"{root}/{row.temporary}", target)
            yield batch

    return _spread(manifest).mapInPandas(run, _MANIFEST)


def _spread(manifest: DataFrame, piece: int = 64 << 20, least: int = 256) -> DataFrame:
    """The files in even shares: one for every ``piece`` bytes, and for every file up to ``least``.

    The number is stated, as rows so small would else be taken for one task's work.
    """
    files, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return manifest.repartitionByRange(max(1, min(files, max(least, -(-size // piece)))), "file")


def _records(stream, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    engine, waiting, data = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not data:
            data = stream.read(piece)
            if not data:
                break
        waiting += engine.decompress(data)
        data = b""
        if engine.eof:
            data = engine.unused_data
            yield _parse(bytes(waiting))
            engine, waiting = zlib.decompressobj(31), bytearray()
    if waiting:
        raise ValueError("the file ends inside a record")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:40]}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(headers["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("a record's block digest is wrong")
    return headers, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the manifest's files, with its digests checked.

    Columns: ``page_id``, ``url``, ``record_type``, ``payload_bytes`` and ``payload_digest`` (of the full
    payload, for revisits as well), ``refers_to`` (the response's page id of a revisit) and ``payload``
    (null for revisits). Files are read side by side, a record at a time. An empty manifest gives no rows, an empty
    payload an empty one, a missing id a null; equal records stay.
    """
    folder = qualified(manifest.sparkSession, folder)
    kind = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for headers, block in _records(stream):
                        rows.append(_row(headers, block))
                        size += len(block)
                        if size > 4 << 20:
                            yield _batch(rows, kind)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, kind)

    schema = (
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary"
    )
    return _spread(manifest).select("file").mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _row(headers: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    full = headers["WARC-Type"] == "response"
    if full and (digest != hashlib.sha256(payload).hexdigest() or len(payload) != int(told["Content-Length"])):
        raise ValueError("a record's payload digest is wrong")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    return (
        int(page) if page else None,
        headers.get("WARC-Target-URI"),
        headers["WARC-Type"],
        int(told["Content-Length"]),
        digest,
        int(refers) if refers else None,
        payload if full else None,
    )
