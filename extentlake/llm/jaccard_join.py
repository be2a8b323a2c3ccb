"""N-gram Jaccard self-join by T-occurrence search.

Documents whose shingle sets are equal form one class.  All shingles have one global order: by hash, those that a bitmap marks
as frequent last.  Two sets that reach the threshold share a shingle among the first n - ceil(threshold * n) + 1 of each
(prefix filter).  A prefix shingle of at most HOT classes gives their pairs; a hotter one is never paired, but gives its
classes a common home.  A class is indexed in its home and asks in the homes of its candidates elsewhere, if they
are smaller ids than its own, so each pair of classes meets once.

A home is cut by the sizes of its sets, so that only neighbouring size classes can hold partners, and each size class into
blocks.  The unit of work is a tile: one block's inverted lists, asked by one block of sets or by themselves.  A tile's
lists are searched for what reaches the required number of occurrences: short lists by a heap of their heads, the longest
(DivideSkip) by binary search.  Blocks grow with the root of what a home holds, so no task holds a home, and a home
of H sets sends each of them to about min(H / BLOCK, root of H) tiles.

Every link is found and counted for both its ends (n_links).  Only a forest of what hangs together comes out as rows, as a
family's links grow with its square; components need no more and are made of it by repeated joins.  Nothing is capped:
a hot shingle or a large home only changes the way.  The bitmaps only order and route: where they fill up, results stay.

Nulls: a null or empty text has an empty set and no link.  A null id counts as no id: it never is the smallest.
Repeated rows: each gives a row.  Extra columns are not read.  An empty table gives no rows.
Classes are told apart by 64 bits of a digest of the set, shingles by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import mix, shingle_sets, slices
from .shared import BITMAP_BITS, bitmap, bits_for, marked, partitions, table, written

#: Classes that may hold a prefix shingle before it counts as hot.
HOT = 8
#: Sets of one block of a home, at least and at most.
BLOCK, LARGEST = 128, 2048
#: Values that a task gathers before it deals them out.
GATHER = 2 << 20
#: DivideSkip's share of long lists: T / (MU * log2(longest list) + 1) lists are long.  A probe costs little beside a step of the heap.
MU = 0.001


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that reaches the threshold."""
    return -(-percent * n // 100)


def class_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _dealt(part: np.ndarray, parts: int, arrays: list[np.ndarray]) -> Iterator[list]:
    """A row for each part: its number and, as bytes, what each array has for it."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    arrays = [a[order] for a in arrays]
    for p in np.flatnonzero(np.diff(cuts)):
        yield [int(p), *(a[cuts[p] : cuts[p + 1]].tobytes() for a in arrays)]


def _rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, len(names)))]
    return pa.RecordBatch.from_arrays(columns, names)


def _counted(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    """How many documents hold each shingle, dealt by the top bits of its hash."""

    def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        low = ((value << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        for rows in _in_turn(_dealt((value >> np.uint64(64 - bits)).astype(np.int64), 1 << bits, [low, np.minimum(count, 255).astype(np.uint8)])):
            yield _rows(rows, ["part", "low", "counts"])

    held, size = [], 0
    for batch in batches:
        for _, _, text, at in slices(batch.column(0)):
            for s in shingle_sets(text, at, k):
                held.append(s)
                size += len(s)
            if size >= GATHER:
                yield from out(held)
                held, size = [], 0
    if size:
        yield from out(held)


def _in_turn(rows: Iterator[list], most: int = 512) -> Iterator[list[list]]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def _frequent(groups: pa.Table, bits: int) -> pa.Table:
    """(place, level): the first 32 bits of each shingle that more than HOT documents hold, and the power of two they reach."""
    part = groups.column("part")[0].as_py()
    low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in groups.column("low")])
    count = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in groups.column("counts")]).astype(np.int64)
    order = np.argsort(low, kind="stable")
    low, count = low[order], count[order]
    first = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
    count = np.add.reduceat(count, first) if len(first) else count
    low, count = low[first][count > HOT], count[count > HOT]
    return pa.table({"place": (np.int64(part) << (32 - bits)) | (low.astype(np.int64) >> bits), "level": np.log2(count).astype(np.int32)})


def _frequent_map(counts: DataFrame, bits: int) -> bytes:
    """A bitmap of the most frequent shingles, as many as fill an eighth of the largest bitmap."""
    found = written(counts.groupBy("part").applyInArrow(lambda t: _frequent(t, bits), "place long, level int"))
    levels, marked_ = {r.level: r.n for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()}, 0  # a row for each power of two
    least = max(levels, default=0) + 1
    while least - 1 in range(64) and (marked_ == 0 or marked_ + levels.get(least - 1, 0) <= 1 << (BITMAP_BITS - 3)):
        least -= 1
        marked_ += levels.get(least, 0)
    size = bits_for(marked_)
    return bitmap(found.where(F.col("level") >= least).select(F.shiftright("place", 32 - size).alias("place")), "place", size)


def _places(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values a bitmap marks, by their first bits."""
    return marked(held, (values >> np.uint64(64 - (len(held).bit_length() + 2))).astype(np.int64))


DEALT = "part long, key binary, cid binary, n binary, place binary, doc_id long, own_n long, own_cid long"


def _postings(batches: Iterator[pa.RecordBatch], k: int, percent: int, bits: int, frequent: bytes) -> Iterator[pa.RecordBatch]:
    """What class each document has (doc_id, own_n, own_cid), and prefix shingles with class, size and place, dealt to parts: each
    class once a task, the frequent ones at random among as many parts again."""
    names = [x.split()[0] for x in DEALT.split(", ")]
    seen, hot_map = set(), np.frombuffer(frequent, np.uint8)

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([h[0] for h in held])
        size = np.array([len(h[0]) for h in held])
        cid = np.repeat(np.array([h[1] for h in held], np.int64), size)
        n = np.repeat(np.array([h[2] for h in held], np.uint32), size)
        place = np.minimum(np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size), 65535).astype(np.uint16)
        part = (key >> np.uint64(64 - bits)).astype(np.int64)
        hot = _places(key, hot_map)
        part[hot] = (1 << bits) + (mix(key[hot] ^ cid[hot].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        for rows in _in_turn(_dealt(part, 2 << bits, [key, cid, n, place])):
            got = _rows(rows, names[:5])
            yield pa.RecordBatch.from_arrays([*got.columns, *(pa.nulls(len(rows), pa.int64()) for _ in range(3))], names)

    held, size = [], 0
    for batch in batches:
        for first, end, text, at in slices(batch.column(1)):
            sets = shingle_sets(text, at, k)
            cids = [class_id(s) for s in sets]
            nulls = [pa.nulls(end - first, t) for t in (pa.int64(), *[pa.binary()] * 4)]
            yield pa.RecordBatch.from_arrays([*nulls, batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(cids, pa.int64())], names)
            for s, cid in zip(sets, cids, strict=True):
                if len(s) and cid not in seen:
                    seen.add(cid)
                    hot = _places(s, hot_map)
                    order = np.concatenate([s[~hot], s[hot]]) if hot.any() else s
                    held.append((order[: len(s) - needed(len(s), percent) + 1].copy(), cid, len(s)))  # not a view, which would hold the set
                    size += len(held[-1][0])
            if size >= GATHER:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def _candidates(groups: pa.Table, percent: int, bits: int) -> pa.Table:
    """Of a part: pairs (a, b) of a key's few classes that size and place leave possible, without key; (key, a) of hot keys."""
    key, cid, n, place = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in groups.column(name)]) for name, kind in (("key", np.uint64), ("cid", np.int64), ("n", np.uint32), ("place", np.uint16)))
    order = np.lexsort((cid, key))
    key, cid, n, place = key[order], cid[order], n[order].astype(np.int64), place[order].astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
    key, cid, n, place = key[new], cid[new], n[new], place[new]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    hot = np.repeat(np.diff(edge) > HOT, np.diff(edge))
    if groups.column("part")[0].as_py() >> bits:
        hot[:] = True  # others of the key are in other parts
    hot_key, hot_cid, hot_n = key[hot], cid[hot], n[hot]
    key, cid, n, place = key[~hot], cid[~hot], n[~hot], place[~hot]
    found = []
    for step in range(1, HOT):  # all pairs of rows so many apart within a bucket
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        j = i + step
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        ok = (100 * low >= percent * high) & ((100 + percent) * most >= percent * (n[i] + n[j]))
        found.append(np.stack([cid[i][ok], cid[j][ok], n[i][ok], n[j][ok]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    a, b, na, nb = (pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(4))
    none = pa.nulls(len(hot_key), pa.int64())
    return pa.concat_tables(
        [
            pa.table({"key": pa.nulls(len(pairs), pa.int64()), "a": a, "b": b, "na": na, "nb": nb}),
            pa.table({"key": pa.array(hot_key.view(np.int64)), "a": pa.array(hot_cid), "b": none, "na": pa.array(hot_n), "nb": none}),
        ]
    )


def _sets(batches: Iterator[pa.RecordBatch], k: int, wanted: bytes) -> Iterator[pa.RecordBatch]:
    """The sets of classes marked in a bitmap, each once a task."""
    bits, seen = np.frombuffer(wanted, np.uint8), set()
    for batch in batches:
        for _, _, text, at in slices(batch.column(0)):
            got = []
            for s in shingle_sets(text, at, k):
                if len(s) and (cid := class_id(s)) not in seen and _places(np.array([cid]).view(np.uint64), bits)[0]:
                    seen.add(cid)
                    got.append((cid, s.tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["cid", "shingles"])


class Index:
    """Inverted lists of some sets, searched for sets that share at least so many values with a query."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, np.array([len(s) for s in sets])
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(value, kind="stable")
        value, self.owner = value[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        self.value, self.cut = value[first], np.append(first, len(value))
        # the lists lie one after another, so (list, owner) is in order over all of them
        self.posting = np.repeat(np.arange(len(first)), np.diff(self.cut)) * len(sets) + self.owner

    def search(self, query: np.ndarray) -> np.ndarray:
        """Places of the sets whose similarity with the query reaches the threshold, in order."""
        least = needed(len(query), self.percent)
        at = np.minimum(np.searchsorted(self.value, query), len(self.value) - 1)
        at = at[self.value[at] == query]
        if len(at) < least:
            return np.zeros(0, np.int64)
        size = self.cut[at + 1] - self.cut[at]
        at = at[np.argsort(size, kind="stable")]
        n_long = min(least - 1, int(least / (MU * np.log2(size.max()) + 1)))
        found, count = self._merged(at[: len(at) - n_long], least - n_long)
        if len(found) and n_long:
            wanted = np.sort(at[len(at) - n_long :])[:, None] * len(self.sizes) + found  # every long list is probed for what was found
            near = np.minimum(np.searchsorted(self.posting, wanted), len(self.posting) - 1)
            count = count + (self.posting[near] == wanted).sum(0)
        both = len(query) + self.sizes[found]
        return found[(100 + self.percent) * count >= self.percent * both]

    def _merged(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """What occurs in at least so many of the lists, with the number of lists: a heap of the lists' heads."""
        found, count, last, times = [], [], -1, 0
        for x in heapq.merge(*[self.owner[self.cut[i] : self.cut[i + 1]].tolist() for i in lists]):
            if x == last:
                times += 1
                continue
            if times >= least:
                found.append(last)
                count.append(times)
            last, times = x, 1
        if times >= least and last >= 0:
            found.append(last)
            count.append(times)
        return np.array(found, np.int64), np.array(count, np.int64)


class Tile:
    """The inverted lists of a block, asked by sets one by one; links join what hangs together, degree counts every link."""

    def __init__(self, cids: list[int], sets: list[np.ndarray], percent: int):
        self.cids, self.sets, self.index = np.array(cids, np.int64), sets, Index(sets, percent)
        self.label, self.degree, self.links = np.arange(len(cids)), np.zeros(len(cids), np.int64), []

    def _joined(self, near: np.ndarray, cid: int | None) -> None:
        """What was found hangs together, with the class that asked if it isn't of the block."""
        labels = np.unique(self.label[near])
        first = int(self.cids[labels[0]]) if cid is None else cid
        self.links += [(first, int(self.cids[x]), 0) for x in (labels[1:] if cid is None else labels)]
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def among(self) -> None:
        """Links within the block."""
        for x, values in enumerate(self.sets if len(self.sets) > 1 else ()):
            near = self.index.search(values)
            self.degree[x] += len(near) - 1  # it finds itself
            self._joined(near, None)

    def ask(self, cid: int, values: np.ndarray) -> None:
        near = self.index.search(values)
        if len(near):
            self.degree[near] += 1
            self.links.append((cid, cid, len(near)))
            self._joined(near, cid)

    def closed(self) -> list[tuple[int, int, int]]:
        return self.links + [(int(self.cids[i]), int(self.cids[i]), int(self.degree[i])) for i in np.flatnonzero(self.degree)]


#: What a set is in a tile: indexed and asking all of its block, indexed, or asking.
WITHIN, INDEXED, ASKING = range(3)


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b, 0) of the forest, and (a, a, n): n links of a.  Rows come sorted by tile and role; a task holds one tile's lists at a time."""
    key, role, cids, sets, tile, links = None, WITHIN, [], [], None, []

    def closed() -> list[tuple[int, int, int]]:
        made = tile or (Tile(cids, sets, percent) if cids and role == WITHIN else None)
        if made and role == WITHIN:
            made.among()
        return made.closed() if made else []

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for number, role_, cid, shingles in zip(*columns, batch.column(3), strict=True):
            if number != key:
                links += closed()
                key, cids, sets, tile = number, [], [], None
            role = role_
            values = np.frombuffer(shingles.as_buffer(), np.uint64)
            if role != ASKING:
                cids.append(cid)
                sets.append(values.copy())
            elif cids:
                tile = tile or Tile(cids, sets, percent)
                tile.ask(cid, values)
        if len(links) > 50_000:
            yield _linked(links)
            links = []
    links += closed()
    yield _linked(links)


def _linked(links: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(3)], ["a", "b", "n"])


def _keyed(df: DataFrame, *columns: str, times: int = 0) -> DataFrame:
    return df.withColumn("key", F.xxhash64(F.lit(times), *columns))


def tiles(homes: DataFrame, visits: DataFrame, percent: int) -> DataFrame:
    """(tile, role, cid) from classes and their sizes (cid, n, home), and those that ask in other homes.

    Size classes are so wide that two sets that reach the threshold are of the same or of neighbouring ones; a pair of one
    home meets in the lower of theirs, one of the blocks asking the other.
    """
    width = max(-math.log(percent / 100) * (1 + 1e-9), 1e-9)
    sized = lambda df: df.select("cid", "home", F.floor(F.log("n") / width).alias("size"))
    pieces = F.ceil(F.col("held") / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST), F.ceil(F.sqrt("held"))))).cast("long")
    grouped = lambda df: df.groupBy("home", "size").agg(F.count("*").alias("held")).select("home", "size", pieces.alias("pieces"))
    # keyed apart from the joins before and after, so that each takes plain shuffles, of which adaptive execution splits a large home's
    within = lambda df, groups: _keyed(df, "home", "size").join(_keyed(groups, "home", "size"), ["key", "home", "size"]).withColumn("piece", F.expr("pmod(xxhash64(cid), pieces)")).drop("key")
    homes, visits = sized(homes), sized(visits)
    groups, comers = grouped(homes), grouped(visits)
    own, guests = within(homes, groups), within(visits, comers)
    # who asks the blocks of (home, of): kind 0 the same size class, 1 the next one, 2 visitors of the three sizes that can match
    near = F.explode(F.expr("sequence(size - 1, size + 1)")).alias("of")
    asked = lambda own, guests, last: own.selectExpr("home", "size AS of", "0 AS kind", "size AS by", *last).union(own.selectExpr("home", "size - 1 AS of", "1 AS kind", "size AS by", *last)).union(guests.select("home", near, F.lit(2).alias("kind"), F.col("size").alias("by"), *last))
    target = groups.selectExpr("home", "size AS of", "pieces AS blocks")
    sides = asked(groups, comers, ["pieces"]).join(target, ["home", "of"]).select("home", F.col("of").alias("size"), "kind", "by", F.col("pieces").alias("n_by"))
    tile = F.expr("xxhash64(home, of, kind, by, block, piece)")
    ask = _keyed(asked(own, guests, ["piece", "cid"]), "home", "of", times=2).join(_keyed(target, "home", "of", times=2), ["key", "home", "of"])
    ask = ask.where("kind != 0 OR piece > 0").withColumn("block", F.explode(F.expr("sequence(0L, IF(kind = 0, piece, blocks) - 1)")))
    held = own.select("home", "size", "cid", F.col("piece").alias("block"))
    held = _keyed(held, "home", "size", times=1).join(_keyed(sides, "home", "size", times=1), ["key", "home", "size"]).withColumnRenamed("size", "of")
    held = held.withColumn("piece", F.explode(F.expr("sequence(IF(kind = 0, block, 0L), n_by - 1)")))
    role = F.when(F.expr("kind = 0 AND block = piece"), WITHIN).otherwise(INDEXED)
    return held.select(tile.alias("tile"), role.alias("role"), "cid").union(ask.select(tile.alias("tile"), F.lit(ASKING).alias("role"), "cid"))


def links(docs: DataFrame, text: str = "text", k: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forest of links (a, b) between classes, the number of all links of each class that has any: (cid, n_links), and
    what class every row has: (doc_id, n, cid), in the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"))
    bits = max(6, int(np.ceil(np.log2(4 * partitions(spark)))))

    counts = texts.mapInArrow(lambda b: _counted(b, k, bits), "part long, low binary, counts binary")
    sent = spark.sparkContext.broadcast(_frequent_map(counts, bits))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = written(rows.mapInArrow(lambda b: _postings(b, k, percent, bits, sent.value), DEALT))
    classes = dealt.where("own_cid IS NOT NULL").selectExpr("doc_id", "own_n AS n", "own_cid AS cid")
    groups = dealt.where("part IS NOT NULL").select("part", "key", "cid", "n", "place").groupBy("part")
    found = written(groups.applyInArrow(lambda t: _candidates(t, percent, bits), "key long, a long, b long, na long, nb long"))

    pairs = found.where("key IS NULL").select("a", "b", "na", "nb").distinct()
    hot_keys = found.where("key IS NOT NULL").selectExpr("key", "a AS cid", "na AS n").distinct()
    shared_keys = hot_keys.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least != most").drop("most")
    pairs, hot_keys = written(pairs), written(hot_keys.join(shared_keys, "key"))
    label = pairs.selectExpr("a AS cid", "na AS n", "least(a, b) AS home").union(pairs.selectExpr("b", "nb", "least(a, b)")).union(hot_keys.selectExpr("cid", "n", "least"))
    homes = written(label.groupBy("cid").agg(F.min("n").alias("n"), F.min("home").alias("home")))

    ha, hb = homes.selectExpr("cid AS a", "home AS ha"), homes.selectExpr("cid AS b", "home AS hb")
    visits = pairs.join(ha, "a").join(hb, "b").where("ha != hb").selectExpr("IF(ha > hb, a, b) AS cid", "IF(ha > hb, na, nb) AS n", "least(ha, hb) AS home")
    at_key = hot_keys.join(homes.select("cid", "home"), "cid").select("key", "cid", "n", "home")
    key_homes = at_key.select("key", F.col("home").alias("other")).distinct()
    visits = written(visits.union(at_key.join(key_homes, "key").where("other < home").selectExpr("cid", "n", "other AS home")).distinct())
    todo = tiles(homes, visits, percent)

    size = bits_for(homes.count())
    wanted = bitmap(homes.select(F.shiftrightunsigned("cid", 64 - size).alias("place")), "place", size)
    sent_wanted = spark.sparkContext.broadcast(wanted)
    # each class once, whatever tasks hold its copies; the shuffle is the one that the join needs
    sets = texts.mapInArrow(lambda b: _sets(b, k, sent_wanted.value), "cid long, shingles binary").dropDuplicates(["cid"])
    work = todo.hint("shuffle_merge").join(sets, "cid").select("tile", "role", "cid", "shingles")
    work = work.repartition(partitions(spark), "tile").sortWithinPartitions("tile", "role", "cid")
    met = written(work.mapInArrow(lambda b: _search(b, percent), "a long, b long, n long"))
    degree = met.where("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
    return met.where("a != b").select("a", "b").distinct(), degree, classes


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it can reach.

    Each round, a node's neighbours above it and itself move to its smallest neighbour, then the same for those
    below it; trees flatten in a logarithmic number of rounds.  Each round is a table in the shared folder.
    """
    edges = written(edges.where("a != b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    while True:
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        low = written(both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low")))  # apart from the join, so that adaptive execution can split a hub there
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "low AS b").where("a != b")
        large = large.union(low.where("a != low").selectExpr("a", "low AS b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b != low").selectExpr("b AS a", "low AS b").union(low.selectExpr("a", "low AS b"))
        new = written(small.where("a != b").distinct())
        ends = new.selectExpr("a AS node", "1 AS up", "0 AS down").union(new.selectExpr("b", "0", "1"))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        edges = new
        if ends.where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return edges.selectExpr("a AS node", "b AS root").union(edges.select("b", "b").distinct().toDF("node", "root"))


def join_components(docs: DataFrame, text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row; n_links: classes, other than its own, whose similarity with it reaches the threshold."""
    forest, degree, classes = links(docs, text, k, percent)
    roots = components(forest)
    least = classes.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"))
    least = least.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    of_root = least.groupBy("root").agg(F.min("first").alias("component_id"))
    # keyed anew, so that each join takes plain shuffles, of which adaptive execution splits a large component's or class's
    named = _keyed(least, "root").join(_keyed(of_root, "root"), ["key", "root"]).select("cid", "component_id").join(degree, "cid", "left")
    return _keyed(classes, "cid").join(_keyed(named, "cid"), ["key", "cid"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op10_ngram_jaccard_join": op10_ngram_jaccard_join}
SQL = {
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT row, hash(array_to_string(w[k:k + 3], ' ')) AS g
  FROM (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n FROM g GROUP BY row),
p AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.row <> b.row GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.row = x JOIN n ny ON ny.row = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, min(o.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (row) LEFT JOIN r ON r.x = d.row LEFT JOIN d o ON o.row = r.y GROUP BY d.row, d.doc_id, n.n"""
}
