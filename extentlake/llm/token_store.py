"""Token ids in binary shards, with a minimal perfect hash index over document keys.

A shard file holds a head of 16 bytes (FORMAT, version, bytes for an id) and then the raw little-endian ids of a
range of documents in ascending doc_id order, each with the end id.  Documents are dealt by range of doc_id, encoded, sorted and
appended within one task, so the text moves once and ids go straight to their file.

An index part holds the keys that fall to it by hash.  Its minimal perfect hash is a cascade of bit arrays: a key is
settled at the first level where no other key shares its bit, and its slot is the number of bits set before.
A slot stores a fingerprint, the shard, the place in it and the number of ids: a lookup costs the few levels and one read.
A document's key is its id, whether it has none, and its number among rows of that id; those whose 64-bit keys are equal are
kept apart, whole.
Part and shard counts follow the size of the data.

Files carry their name only when whole, and the same task writes the same bytes, so a lost executor's work is done again.

Nulls: a null or empty text is the end id alone; null doc_ids come first.  Repeated rows of a doc_id keep their order
of text and have one key each, told apart by their number.  Extra columns are not read.  An empty table has no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import content, make_folder, opened, whole
from .kernel import mix
from .pretokens import Encoder
from .shared import partitions, shared_dir, table, written

FORMAT, INDEX_FORMAT, VERSION = b"TOKENIDS", b"TOKENMPH", 1
HEAD = struct.Struct("<8sII")
#: Bits for a key at each level of the index.
GAMMA = 2.0
#: Characters that are encoded at once.
AT_ONCE = 1 << 19
#: Levels after which distinct keys would have met by chance less often than a machine fails.
MOST_LEVELS = 200


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoded(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, wide: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by doc_id go to one shard file; out come their keys and places."""
    from pyspark import TaskContext

    encoder, shard, kind = _encoder(tokenizer), TaskContext.get().partitionId(), {2: "<u2", 4: "<u4"}[wide]
    batches = (b for b in batches if b.num_rows)
    head = next(batches, None)
    if head is None:
        return
    place, last, number = 0, None, 0
    with whole(f"{folder}/{shard:06d}.ids") as out:
        out.write(HEAD.pack(FORMAT, VERSION, wide))
        for batch in _chain(head, batches):
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            first = 0
            while first < len(keys):
                texts, size, stop = [], 0, first
                while stop < len(keys) and (size < AT_ONCE or not texts):
                    texts.append(column[stop].as_py() or "")
                    size += len(texts[-1])
                    stop += 1
                ids, count = encoder.encode(texts)
                ends = np.cumsum(count + 1)
                full = np.full(int(ends[-1]), end_id, kind)
                inside = np.ones(len(full), bool)
                inside[ends - 1] = False
                full[inside] = ids
                out.write(full.tobytes())
                numbers = []
                for k in keys[first:stop]:
                    number = number + 1 if last == (k,) else 0
                    last = (k,)
                    numbers.append(number)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first:stop], pa.int64()), pa.array(numbers, pa.int32()), pa.array([shard] * (stop - first), pa.int32()), pa.array(place + ends - count - 1, pa.int64()), pa.array(count + 1, pa.int64())],
                    ["doc_id", "number", "shard", "place", "n_tokens"],
                )
                place += int(ends[-1])
                first = stop


def _chain(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, before, self.ranks = levels, 0, []
        for _, bits in levels:
            counts = np.unpackbits(bits.reshape(-1, 8), axis=1).sum(1)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())

    @staticmethod
    def built(keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("equal keys have no perfect hash")
            size = max(64, int(GAMMA * len(left)) // 64 * 64 + 64)
            spot = _spot(left, len(levels), size)
            count = np.bincount(spot, minlength=size)
            bits = np.packbits(count == 1, bitorder="little")
            levels.append((size, bits))
            left = left[count[spot] > 1]
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that settles at no level."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (size, bits) in enumerate(self.levels):
            spot = _spot(keys[open_], level, size)
            byte, bit = spot >> 3, spot & 7
            hit = (bits[byte] >> bit.astype(np.uint8)) & 1 == 1
            at, where = open_[hit], spot[hit]
            word = where >> 6
            within = np.unpackbits(bits.reshape(-1, 8)[word], axis=1, bitorder="little")
            within = (within * (np.arange(64) < (where & 63)[:, None])).sum(1)
            out[at] = self.ranks[level][word] + within
            open_ = open_[~hit]
        return out


def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def key_hash(doc_id: np.ndarray, absent: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One-to-one for the first row of a doc_id that isn't null."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + absent.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


_PLACE = [("shard", "<u4"), ("place", "<u8"), ("n", "<u8")]
ENTRY = np.dtype([("fingerprint", "<u4"), *_PLACE])
#: What an index part keeps of keys that share their hash.
APART = np.dtype([("doc_id", "<i8"), ("absent", "<u4"), ("number", "<u4"), *_PLACE])


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)


def _index(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part; each part's rows become one index file."""
    part, held = None, []
    for batch in batches:
        parts = batch.column(0).to_numpy()
        for p in np.unique(parts).tolist():
            if p != part:
                if held:
                    yield _index_file(folder, part, pa.Table.from_batches(held))
                part, held = p, []
            first, end = np.searchsorted(parts, [p, p + 1])
            held.append(batch.slice(first, end - first))
    if held:
        yield _index_file(folder, part, pa.Table.from_batches(held))


def _index_file(folder: str, part: int, rows: pa.Table) -> pa.RecordBatch:
    named = {c: rows.column(c).to_numpy() for c in ("doc_id", "absent", "number", "shard", "place", "n_tokens")}
    named["n"] = named.pop("n_tokens")
    keys = key_hash(named["doc_id"], named["absent"], named["number"])
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    alone = times[which] == 1
    apart = np.zeros(int((~alone).sum()), APART)
    for name in APART.names:
        apart[name] = named[name][~alone]
    keys = keys[alone]
    mph = PerfectHash.built(keys)
    entries, at = np.zeros(len(keys), ENTRY), mph.slots(keys)
    entries["fingerprint"][at] = _fingerprint(keys)
    for name, _ in _PLACE:
        entries[name][at] = named[name][alone]
    with whole(f"{folder}/{part:06d}.mph") as out:
        out.write(HEAD.pack(INDEX_FORMAT, VERSION, len(mph.levels)) + struct.pack("<QQ", len(keys), len(apart)))
        for size, bits in mph.levels:
            out.write(struct.pack("<Q", size) + bits.tobytes())
        out.write(entries.tobytes() + apart.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(alone)], pa.int64())], ["part", "n"])


class IndexPart:
    """An index part, opened: lookup(doc_ids, absent, numbers) gives its entries and which were found."""

    def __init__(self, uri: str):
        data = content(uri)
        name, version, n_levels = HEAD.unpack_from(data)
        if (name, version) != (INDEX_FORMAT, VERSION):
            raise ValueError(f"{uri} is no index part")
        (n, n_apart), at, levels = struct.unpack_from("<QQ", data, HEAD.size), HEAD.size + 16, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", data, at)
            levels.append((size, np.frombuffer(data, np.uint8, size // 8, at + 8)))
            at += 8 + size // 8
        self.mph, self.entries = PerfectHash(levels), np.frombuffer(data, ENTRY, n, at)
        self.apart = np.frombuffer(data, APART, n_apart, at + n * ENTRY.itemsize)

    def lookup(self, doc_id: np.ndarray, absent: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = key_hash(doc_id, absent, number)
        slot = self.mph.slots(keys)
        found = self.entries[np.maximum(slot, 0)] if len(self.entries) else np.zeros(len(keys), ENTRY)
        ok = (slot >= 0) & (found["fingerprint"] == _fingerprint(keys))
        for row in self.apart:
            mine = (doc_id == row["doc_id"]) & (absent == row["absent"]) & (number == row["number"])
            for name, _ in _PLACE:
                found[name][mine] = row[name]
            ok |= mine
        return found, ok


def _looked_up(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, absent, number, part) of one task may be of several parts; each is opened when its rows come."""
    part, index = None, None
    for batch in batches:
        keys, absent, number, parts = (batch.column(i).to_numpy() for i in range(4))
        for p in np.unique(parts):
            if p != part:
                part, index = p, IndexPart(f"{folder}/{p:06d}.mph")
            mine = parts == p
            found, ok = index.lookup(keys[mine], absent[mine], number[mine])
            if not ok.all():
                raise ValueError(f"index part {p} lacks {int((~ok).sum())} keys")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[mine], mask=absent[mine] > 0), pa.array(found["shard"].astype(np.int32)), pa.array(found["place"].astype(np.int64)), pa.array(found["n"].astype(np.int64))],
                ["key", "shard", "place", "n_tokens"],
            )


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Reads each document's ids at its place in its shard."""
    shard, file, wide = None, None, 0
    for batch in batches:
        shards, place, n = (batch.column(i).to_numpy() for i in range(1, 4))
        crc = np.empty(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            if shards[i] != shard:
                if file is not None:
                    file.close()
                shard, file = shards[i], opened(f"{folder}/{shards[i]:06d}.ids")
                name, version, wide = HEAD.unpack(file.read(HEAD.size))
                if (name, version) != (FORMAT, VERSION):
                    raise ValueError(f"shard {shard} is no token file")
            file.seek(HEAD.size + int(place[i]) * wide)
            data = file.read(int(n[i]) * wide)
            if len(data) != n[i] * wide:
                raise ValueError(f"shard {shard} ends early")
            crc[i] = zlib.crc32(np.frombuffer(data, f"<u{wide}").astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards), pa.array(place), pa.array(n), pa.array(crc)], ["key", "shard", "place", "n_tokens", "ids_crc32"])


def keyed(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a doc_id that is never null, whether it was, and the index part of the key."""
    part = F.pmod(F.xxhash64("doc_id", "number"), F.lit(parts)).cast("int")
    return rows.withColumns({"part": part, "absent": F.col("doc_id").isNull().cast("int"), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))})


def write(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = 2) -> tuple[str, DataFrame]:
    """Writes shards and index to a folder; gives its path and the table (doc_id, number, shard, place, n_tokens)."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    folder = shared_dir(spark)
    make_folder(folder)
    wide = 2 if max(_encoder(path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    places = written(dealt.mapInArrow(lambda b: _encoded(b, folder, path, end_id, wide), "doc_id long, number int, shard int, place long, n_tokens long"))
    parts = partitions(spark)
    by_part = keyed(places, parts).repartition(parts, "part").sortWithinPartitions("part").select("part", "doc_id", "absent", "number", "shard", "place", "n_tokens")
    written(by_part.mapInArrow(lambda b: _index(b, folder), "part int, n long"))
    return folder, places


def read(folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, shard, place, n_tokens, ids_crc32) of the rows (doc_id, number) through the index and the shards."""
    spark = keys.sparkSession
    parts = partitions(spark)
    rows = keyed(keys.select("doc_id", "number"), parts).select("doc_id", "absent", "number", "part")
    rows = rows.repartition(parts, "part").sortWithinPartitions("part")
    places = rows.mapInArrow(lambda b: _looked_up(b, folder), "key long, shard int, place long, n_tokens long")
    places = places.repartition(parts, "shard").sortWithinPartitions("shard", "place")
    got = places.mapInArrow(lambda b: _read(b, folder), "key long, shard int, place long, n_tokens long, ids_crc32 long")
    return got.select(F.col("key").alias("doc_id"), "shard", "place", "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes all documents and reads each back: (doc_id, start, n_tokens, ids_crc32)."""
    folder, places = write(docs, text, tokenizer, end_id)
    sizes = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    got = read(folder, places.select("doc_id", "number"))
    return got.join(starts, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_output": op3_token_output}
SQL: dict[str, str] = {}
