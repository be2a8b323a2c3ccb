"""Benchmark decontamination with suffix arrays of the training text.

Training documents are taken in shards of SHARD_WORDS words.  A shard's suffix array holds its suffixes in the order
of their first WINDOW words; those that begin with fewer words of the benchmark's vocabulary than its shortest
window can match nothing and are left out.  Every suffix of every test item is looked up by binary search, all of them
at once: the range found gives all locations.  Locations that follow one another in an item make its longest matches, which
matches() returns with their places; runs shorter than a window are not sought.  Arrays are made of what a task reads and not kept,
as they leave out what the benchmark at hand can't match.
The benchmark goes out in blocks of ITEM_WORDS words, so its size is not bounded; a task opens one after another, each once for SHARDS shards.

Nulls: a null or empty text, or one without a word, has no words, no hit and is clean; a null item_id is left out of
the digest but its windows count as hits.  Repeated rows: each gives a row.  An empty benchmark hits nothing.  Extra
columns are not read.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import content, make_folder, whole
from .kernel import ALNUM, slices, word_bounds, word_hashes
from .shared import shared_dir, table

WINDOW = 13
SHARD_WORDS = 1 << 20
ITEM_WORDS = 4 << 20
#: Shards whose words a task holds while it opens the blocks of the benchmark.
SHARDS = 8


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, text, at in slices(batch.column(1)):
            start, stop, before = word_bounds(text, at, ALNUM)
            words = word_hashes(text, start, stop, True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array([words[before[i] : before[i + 1]].tobytes() for i in range(end - first)], pa.binary())], ["item_id", "words"]
            )


class Items:
    """A block of test items: their words as ranks, and their distinct windows packed for the search."""

    def __init__(self, ids: list[str | None], words: list[np.ndarray], window: int):
        self.ids = ids
        everything = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.vocabulary, rank = np.unique(everything, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        size = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(size) - size
        n_windows = np.where(size == 0, 0, np.maximum(size - window + 1, 1))
        self.item = np.repeat(np.arange(len(words)), n_windows)
        self.start = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        length = np.minimum(size[self.item], window)
        self.depth = window
        padded = np.append(rank, np.zeros(window, np.int64))
        first = (base[self.item] + self.start)[:, None] + np.arange(window)
        ranks = np.where(np.arange(window) < length[:, None], padded[np.minimum(first, len(padded) - 1)], 0)
        distinct, self.window = np.unique(ranks, axis=0, return_inverse=True)
        self.window = self.window.reshape(-1)
        self.length = (distinct > 0).sum(1)
        self.shortest = int(self.length.min()) if len(distinct) else 0
        self.low = pack(distinct, self.bits)
        self.high = pack(np.where(distinct > 0, distinct, (1 << self.bits) - 1), self.bits)
        self.order = np.argsort(self.window, kind="stable")
        self.cut = np.searchsorted(self.window[self.order], np.arange(len(distinct) + 1))

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Ranks of a shard's words, 0 where the items lack the word."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        return np.where(self.vocabulary[at] == words, at + 1, 0) if len(self.vocabulary) else np.zeros(len(words), np.int64)


def pack(ranks: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of ranks as fewer columns of 64 bits with the same order."""
    each = 63 // bits
    out = []
    for k in range(0, ranks.shape[1], each):
        value = np.zeros(len(ranks), np.int64)
        for j in range(k, k + each):
            value <<= bits
            if j < ranks.shape[1]:
                value |= ranks[:, j]
        out.append(value)
    return out


def suffix_array(rank: np.ndarray, before: np.ndarray, items: Items) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the suffixes that can match begin, in order, and their packed first words."""
    known = np.zeros(len(rank) + 1, bool)
    known[:-1] = rank > 0
    # how many known words follow, the word itself included, within the document
    end = np.where(~known, np.arange(len(known)), len(known))
    end = np.minimum.accumulate(end[::-1])[::-1]
    doc = np.searchsorted(before, np.arange(len(rank)), "right") - 1
    run = np.minimum(end[:-1], before[doc + 1]) - np.arange(len(rank))
    at = np.flatnonzero(run >= max(items.shortest, 1))
    padded = np.append(rank, np.zeros(items.depth, np.int64))
    keys = pack(np.where(np.arange(items.depth) < np.minimum(run[at], items.depth)[:, None], padded[at[:, None] + np.arange(items.depth)], 0), items.bits)
    order = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
    return at[order], [k[order] for k in keys]


def bisect(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For every wanted tuple its place in sorted tuples, by a binary search of all at once."""
    n = len(keys[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        look = np.minimum(middle, n - 1)
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for k, w in zip(keys, wanted, strict=True):
            less |= equal & (k[look] < w)
            equal &= k[look] == w
        up = open_ & (less | equal if right else less)
        low = np.where(up, middle + 1, low)
        high = np.where(open_ & ~up, middle, high)
    return low


def locate(words: np.ndarray, before: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place of a word in the shard, number of a distinct window that begins there), for all occurrences."""
    none = np.zeros(0, np.int64)
    if not len(items.length):
        return none, none
    at, keys = suffix_array(items.ranks(words), before, items)
    if not len(at):
        return none, none
    first, last = bisect(keys, items.low, False), bisect(keys, items.high, True)
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return at[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], which


def _spans(place: np.ndarray, which: np.ndarray, items: Items) -> list[tuple]:
    """(item_id, first word in the shard, first word in the item, words) of the longest matches: occurrences of an item's windows that follow one another."""
    n = items.cut[which + 1] - items.cut[which]
    entry = items.order[np.repeat(items.cut[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    place = np.repeat(place, n)
    item, diagonal = items.item[entry], place - items.start[entry]
    order = np.lexsort((place, diagonal, item))
    item, diagonal, place, last, start = item[order], diagonal[order], place[order], items.length[items.window[entry]][order], items.start[entry][order]
    new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]))
    ends = np.append(new[1:], len(place)) - 1
    return [(items.ids[i], int(p), int(q), int(k)) for i, p, q, k in zip(item[new], place[new], start[new], place[ends] + last[ends] - place[new], strict=True)]


_OPEN: dict[str, Items] = {}


def _block(path: str, window: int) -> Items:
    if path not in _OPEN:
        _OPEN.clear()
        with pa.ipc.open_stream(content(path)) as stream:
            got = stream.read_all()
        _OPEN[path] = Items(got.column("item_id").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint64) for x in got.column("words")], window)
    return _OPEN[path]


class Shard:
    """The words of some documents, and what was found in them."""

    def __init__(self, ids: list[pa.Array], held: list[np.ndarray], sizes: list[np.ndarray]):
        self.ids, self.words, self.before = pa.concat_arrays(ids), np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.edge, self.spans = np.zeros(len(self.words) + 1, np.int64), {}

    def search(self, items: Items) -> None:
        place, which = locate(self.words, self.before, items)
        np.add.at(self.edge, place, 1)
        np.add.at(self.edge, place + items.length[which], -1)
        doc = np.searchsorted(self.before, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        doc, place, which = doc[order], place[order], which[order]
        for d in np.unique(doc):
            a, z = np.searchsorted(doc, [d, d + 1])
            self.spans.setdefault(int(d), []).extend(_spans(place[a:z], which[a:z], items))

    def judged(self, share: int) -> pa.RecordBatch:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.edge[:-1]) > 0)])
        n_hit, n_words = hit[self.before[1:]] - hit[self.before[:-1]], np.diff(self.before)
        docs = range(len(self.ids))
        found = [{x[0] for x in self.spans.get(d, ())} for d in docs]
        return pa.RecordBatch.from_arrays(
            [
                self.ids,
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i for i in x if i is not None)).encode()).hexdigest() for x in found], pa.string()),
                pa.array((n_hit > 0) & (share * n_hit >= n_words), pa.bool_()),
                pa.array([max((x[3] for x in self.spans.get(d, ())), default=0) for d in docs], pa.int64()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"],
        )

    def listed(self) -> pa.RecordBatch:
        rows = [(d, item, p - int(self.before[d]), q, n) for d, spans in sorted(self.spans.items()) for item, p, q, n in spans]
        return pa.RecordBatch.from_arrays(
            [self.ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))],
            ["doc_id", "item_id", "at_word", "item_word", "n_words"],
        )


def _scan(batches: Iterator[pa.RecordBatch], paths: list[str], window: int) -> Iterator[Shard]:
    def searched(shards: list[Shard]) -> list[Shard]:
        for path in paths:
            items = _block(path, window)
            for shard in shards:
                shard.search(items)
        return shards

    ids, held, sizes, total, shards = [], [], [], 0, []
    for batch in batches:
        for first, end, text, at in slices(batch.column(1)):
            start, stop, before = word_bounds(text, at, ALNUM)
            ids.append(batch.column(0).slice(first, end - first))
            held.append(word_hashes(text, start, stop, True))
            sizes.append(np.diff(before))
            total += len(start)
            if total >= SHARD_WORDS:
                shards.append(Shard(ids, held, sizes))
                ids, held, sizes, total = [], [], [], 0
                if len(shards) == SHARDS:
                    yield from searched(shards)
                    shards = []
    if ids:
        shards.append(Shard(ids, held, sizes))
    yield from searched(shards)


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[str]:
    """Files with the items' words, each of about ITEM_WORDS words; items pass through the driver one block at a time."""
    folder = shared_dir(benchmark.sparkSession)
    make_folder(folder)
    rows = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).mapInArrow(_item_words, "item_id string, words binary")
    paths, held, size = [], [], 0

    def close() -> None:
        made = pa.table({"item_id": pa.array([h[0] for h in held], pa.string()), "words": pa.array([h[1] for h in held], pa.binary())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, made.schema) as writer:
            writer.write_table(made)
        paths.append(f"{folder}/{len(paths)}.arrow")
        with whole(paths[-1]) as f:
            f.write(sink.getvalue())

    for row in rows.toLocalIterator():
        held.append((row.item_id, bytes(row.words)))
        size += len(row.words) // 8
        if size >= ITEM_WORDS:
            close()
            held, size = [], 0
    if held:
        close()
    return paths


def _found(docs: DataFrame, benchmark: DataFrame, text: str, window: int, out: Callable[[Shard], pa.RecordBatch], schema: str) -> DataFrame:
    paths = item_blocks(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: map(out, _scan(b, paths, window)), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each document: its words, how many a test window covers, the items, whether share * hits >= words, the longest match."""
    return _found(docs, benchmark, text, window, lambda s: s.judged(share), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Where documents hold what the benchmark holds: (doc_id, item_id, at_word, item_word, n_words), the longest matches of at least a window."""
    return _found(docs, benchmark, text, window, Shard.listed, "doc_id long, item_id string, at_word long, item_word long, n_words long")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


QUERIES = {"op9_decontamination": op9_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op9_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT row, k, m, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT row, k, m, item_id FROM dw JOIN win USING (g, m)),
cov AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + m)) AS p FROM hit) GROUP BY row),
it AS (SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (row) LEFT JOIN it USING (row)"""
}
