"""WARC archives written and read as a table of chunks.

A payload is a run of rows (record, chunk number, bytes) of at most CHUNK bytes, cut on the JVM side, so neither writer nor
reader holds a record: the writer streams chunks into the archive, the reader streams the archive's bytes into chunks.
Each chunk carries the number of bytes and the digest of the payload so far; the last chunk's are the record's.

Records with equal payloads: the one with the smallest page_id is the response, the others are revisits that name it.
Responses are written first; a record's id holds its archive and place, so no two share one, and revisits, which have no
payload, are written when the ids that they refer to are known.  Digests are counted by (digest, smallest id) before
anything is shuffled by them, and the join back is one that adaptive execution splits, so a payload that a third of the pages
share is no hot spot.  Archives are gzip members, one a record.

Nulls: a null html is an empty payload; a null page_id is never the one referred to while another has the payload.  A null url is written
empty.  Repeated rows: each gives a record, and all with the smallest page_id are responses, of which revisits name one.  Extra columns are not
read.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import make_folder, opened, whole
from .shared import partitions, shared_dir, table, written

#: Bytes of payload in one row.
CHUNK = 1 << 20
#: Bytes of the file that are read at once.
READ = 1 << 18
LEVEL = 3
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNKS = "page_id long, record_type string, refers_to long, chunk long, is_last boolean, bytes_so_far long, digest_so_far string, data binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, archive: str, place: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{archive}:{place}>"


def head(record: str, url: str | None, n_bytes: int, digest: str, refers_to: str | None) -> bytes:
    """The WARC and HTTP heads of a record; what follows is the payload of a response, and nothing for a revisit."""
    http = HTTP % n_bytes
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if refers_to else n_bytes)}",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def decided(pages: DataFrame, least_bytes: int = 0, html: str = "html") -> DataFrame:
    """The pages with payload, n_bytes, digest, kind and refers_to."""
    data = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    url = "url" if "url" in pages.columns else None
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.unhex(F.sha1("payload"))})
    keys = rows.select("page_id", "n_bytes", "digest")
    first = keys.where(F.col("n_bytes") >= least_bytes).groupBy("digest", "n_bytes").agg(F.count("*").alias("n"), F.min("page_id").alias("least")).where("n > 1").drop("n")
    first = written(first)
    held = rows.alias("r").join(first.alias("f"), ["digest", "n_bytes"], "left")
    again = F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("least")))
    return held.withColumns({"kind": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("least"))})


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of the payloads; an empty one has one, without bytes."""
    last = F.greatest(F.ceil(F.col("n_bytes") / chunk) - 1, F.lit(0)).cast("int")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("page_id", "url", "n_bytes", "digest", "chunk", F.expr(f"substring(payload, chunk * {chunk} + 1, {chunk})").alias("data"))


PLACES = "archive string, page_id long, digest binary, place long"


def _placed(archive: str, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([archive] * len(held), pa.string()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array([h[2] for h in held], pa.int64())], ["archive", "page_id", "digest", "place"])


def _responses(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Streams the chunk rows of a task, each record's in order, to one archive; says where each record is."""
    from pyspark import TaskContext

    archive, rows = f"{TaskContext.get().partitionId():06d}", _rows(batches)
    row = next(rows, None)
    if row is None:
        return
    held, place = [], 0
    with whole(f"{folder}/{archive}.warc.gz") as out:
        while row is not None:
            page_id, url, n_bytes, digest, _, data = row
            pack, sha, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1(), 0
            out.write(pack.compress(head(record_id(page_id, archive, place), url, n_bytes, base32(digest), None)))
            while True:
                out.write(pack.compress(data))
                sha.update(data)
                size += len(data)
                row = next(rows, None)
                if row is None or row[4] == 0:
                    break
                data = row[5]
            if size != n_bytes or sha.digest() != digest:
                raise ValueError(f"page {page_id}: chunks don't add up to the payload")
            out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            held.append((page_id, digest, place))
            place += 1
            if len(held) == 10_000:
                yield _placed(archive, held)
                held = []
    yield _placed(archive, held)


def _revisits(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the heads of a task's revisits to one archive."""
    from pyspark import TaskContext

    archive, rows = f"r{TaskContext.get().partitionId():06d}", _rows(batches)
    row = next(rows, None)
    if row is None:
        return
    place = 0
    with whole(f"{folder}/{archive}.warc.gz") as out:
        while row is not None:
            page_id, url, n_bytes, digest, least, at, its_place = row
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            out.write(pack.compress(head(record_id(page_id, archive, place), url, n_bytes, base32(digest), record_id(least, at, its_place)) + b"\r\n\r\n") + pack.flush())
            place += 1
            row = next(rows, None)
    yield _placed(archive, [(None, None, place - 1)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


class Stream:
    """The bytes of a file of gzip members, asked for by line or by number."""

    def __init__(self, file):
        self.file, self.raw, self.plain, self.pack = file, b"", bytearray(), None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(READ)
            if not self.raw:
                self.plain += self.pack.flush() if self.pack else b""
                self.pack, had = None, self.pack
                return had is not None
        if self.pack is None:
            self.pack = zlib.decompressobj(31)
        self.plain += self.pack.decompress(self.raw, READ)
        self.raw = self.pack.unconsumed_tail
        if self.pack.eof:
            self.raw, self.pack = self.pack.unused_data, None
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                if self.plain:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.plain[:end])
        del self.plain[: end + 2]
        return out

    def some(self, most: int) -> bytes:
        """From one to so many bytes."""
        while not self.plain:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:most])
        del self.plain[: len(out)]
        return out


def records(file, chunk: int = CHUNK) -> Iterator[tuple]:
    """Chunk rows of an archive: (page_id, record_type, refers_to, chunk, is_last, bytes_so_far, digest_so_far, data).

    A revisit is one row without data; its size and digest are those its head gives for the full payload.
    """
    stream = Stream(file)
    while (line := stream.line()) is not None:
        if line != b"WARC/1.1":
            raise ValueError(f"no record where one should begin: {line[:40]!r}")
        fields = {}
        while line := stream.line():
            name, _, value = line.partition(b": ")
            fields[name.decode().lower()] = value.decode()
        page_id, kind, left = _page(fields["warc-record-id"]), fields["warc-type"], int(fields["content-length"])
        n_bytes, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        while line := stream.line():  # the HTTP head
            left -= len(line) + 2
        left -= 2
        if kind == "revisit":
            yield page_id, kind, _page(fields["warc-refers-to"]), 0, True, n_bytes, digest, b""
        else:
            sha, number, so_far, held = hashlib.sha1(), 0, 0, bytearray()
            while True:
                while left and len(held) < chunk:
                    part = stream.some(min(left, chunk - len(held)))
                    held += part
                    left -= len(part)
                data = bytes(held)
                held.clear()
                sha.update(data)
                so_far += len(data)
                yield page_id, kind, None, number, not left, so_far, base32(sha.digest()), data
                number += 1
                if not left:
                    break
            if base32(sha.digest()) != digest or so_far != n_bytes:
                raise ValueError(f"page {page_id}: the payload isn't the one written")
        if stream.line() != b"" or stream.line() != b"":
            raise ValueError(f"page {page_id}: the record doesn't end where it should")


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_data: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary())])
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], f.type) for i, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for name in batch.column(0).to_pylist():
            with opened(f"{folder}/{name}.warc.gz") as file:
                for row in records(file):
                    held.append(row if with_data else (*row[:7], None))
                    size += len(row[7]) if with_data else 100
                    if size > 4 * CHUNK:
                        yield out()
                        held, size = [], 0
    if held:
        yield out()


def write(pages: DataFrame, least_bytes: int = 0, html: str = "html") -> tuple[str, DataFrame]:
    """Writes archives to a folder; gives its path and the table (archive, n_records)."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    make_folder(folder)
    rows = decided(pages, least_bytes, html)
    placed = written(chunked(rows.where("kind = 'response'")).mapInArrow(lambda b: _responses(b, folder), PLACES))
    again = rows.where("kind = 'revisit'").select("page_id", "url", "n_bytes", "digest", "refers_to")
    named = again.select(F.col("refers_to").alias("of"), F.col("digest").alias("of_digest")).distinct()
    targets = placed.join(named, F.expr("page_id = of AND digest = of_digest")).groupBy("of", "of_digest").agg(F.min(F.struct("archive", "place")).alias("at"))
    heads = again.join(targets, F.expr("refers_to = of AND digest = of_digest")).select("page_id", "url", "n_bytes", "digest", "refers_to", "at.archive", "at.place")
    others = written(heads.mapInArrow(lambda b: _revisits(b, folder), PLACES))
    return folder, written(placed.union(others).groupBy("archive").agg((F.max("place") + 1).alias("n_records")))


def read(spark: SparkSession, folder: str, archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of some archives."""
    names = archives.select("archive").repartition(max(partitions(spark), 1), "archive")
    return names.mapInArrow(lambda b: _read(b, folder, with_data), CHUNKS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = write(table(spark, sf_dir, "pages"))
    ends = read(spark, folder, archives, with_data=False).where("is_last")
    return ends.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op7_warc": op7_warc}
SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
}
