"""Problem 3: entries that differ only in formatting.

Bloom filters over canonical hashes tell which records can have a copy; only
those are shuffled for exact grouping, the others are singletons at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.canon import bare, blank
from lectern.session import cut

#: Bits of a filter for each record of its shard, whatever the number of records.
BITS = 16
#: Bits of one shard at most: 2**22 bits are 512 kB and serve 262,144 records.
SHARD_BITS = 1 << 22
#: Bytes of all shards that are broadcast together; beyond that rows go to their shards.
BROADCAST_BYTES = 16 << 20
#: Hashes that a task gathers before it sends its part of the filters on.
GATHER = 1 << 21
#: A group of more copies is joined by broadcast; at most one record in this many can lead such a group.
HOT = 100_000


def canonical_key(title: Column, body: Column) -> Column:
    """SHA-256 of title and body without formatting; the body's lines in sorted order."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]"), bare), lambda x: x != "")
    return F.unhex(F.sha2(F.concat(F.coalesce(bare(title), F.lit("")), F.lit("\n"), F.array_join(F.array_sort(lines), "\n")), 256))


def _mixed(keys: np.ndarray) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys % np.uint64(shards)).astype(np.int32)


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each 8-byte hash in its shard's filter; ``bits`` is a power of two."""
    x = _mixed(keys)
    return np.stack([x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def held(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    bit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
    return (bit[0] & bit[1]).astype(bool)


def _hash64(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The first 8 bytes of each 32-byte key."""
    raw = b"".join(k[:8] for k in column.to_pylist())
    return np.frombuffer(raw, np.uint64)


PIECES = "shard int, once binary, twice binary"


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["shard", "once", "twice"])


def _packed_places(at: np.ndarray) -> bytes:
    """Sorted positions as compressed differences, so that a piece grows with its hashes and not with the filter."""
    at = np.unique(at)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes(), 1)


def _places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64))


def pieces(keys: np.ndarray, shards: int, bits: int) -> list[tuple]:
    """(shard, places seen once or more, places seen repeatedly) of one part of the hashes."""
    keys, counts = np.unique(keys, return_counts=True)
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    at = positions(keys, bits)[:, order]
    again = counts[order] > 1
    return [(k, _packed_places(at[:, a:b].ravel()), _packed_places(at[:, a:b][:, again[a:b]].ravel())) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def repeat_filters(keyed: DataFrame, shards: int, bits: int) -> DataFrame:
    """(shard, twice): each shard's packed bits of hashes seen repeatedly, merged over all partitions.

    Each partition sends the places of its own hashes; a task merges the
    pieces of one shard after the other as they stream in: a bit is repeated
    where it was so in a piece, or was seen in two. A task holds one shard.
    """

    def fill(batches):
        waiting, n = [], 0
        for batch in batches:
            waiting.append(_hash64(batch.column(0)))
            n += len(waiting[-1])
            if n >= GATHER:
                yield _as_batch(pieces(np.concatenate(waiting), shards, bits))
                waiting, n = [], 0
        if n:
            yield _as_batch(pieces(np.concatenate(waiting), shards, bits))

    def merge(batches):
        now, once, twice = None, None, None

        def done():
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["shard", "twice"])

        for batch in batches:
            for shard, seen, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, once, twice = shard, np.zeros(bits, bool), np.zeros(bits, bool)
                at = _places(seen)
                twice[at[once[at]]] = True
                once[at] = True
                twice[_places(repeated)] = True
        if now is not None:
            yield done()

    parts = keyed.select("key").mapInArrow(fill, PIECES)
    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, twice binary")


def mark_repeats(keyed: DataFrame, n: int, shard_bits: int = SHARD_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``again``: whether the key can come more than once. Keys that do always are marked; of others about one in seventy is.

    The filters have ``BITS`` bits for each of the ``n`` records, in shards of
    at most ``shard_bits``. While all shards together are small they are
    broadcast and rows stay where they are. Beyond that rows, of id and key
    alone, go to the task that holds their shard; those that repeat within
    their own batch are known already and don't, so no hot key follows them.
    """
    bits = min(shard_bits, 1 << max(16, int(np.ceil(np.log2(max(n, 1) * BITS)))))
    shards = max(1, -(-n * BITS // bits))
    filters = repeat_filters(keyed, shards, bits)
    kind = dict(keyed.dtypes)["id"]
    out = f"id {kind}, key binary, again boolean"
    if shards * bits // 8 <= broadcast_bytes:
        spark = keyed.sparkSession
        shared = spark.sparkContext.broadcast([(r.shard, bytes(r.twice)) for r in filters.collect()])  # bounded: broadcast_bytes

        def mark(batches):
            packed = np.zeros(shards * bits // 8, np.uint8)
            for shard, raw in shared.value:
                packed[shard * (bits // 8) : (shard + 1) * (bits // 8)] = np.frombuffer(raw, np.uint8)
            for batch in batches:
                h = _hash64(batch.column(1))
                at = positions(h, bits) + shard_of(h, shards).astype(np.int64) * bits
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held(packed, at))], ["id", "key", "again"])

        return keyed.mapInArrow(mark, out)

    def place(batches):
        for batch in batches:
            h = _hash64(batch.column(1))
            _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(h, shards)), pa.array(counts[back.ravel()] > 1)], ["id", "key", "shard", "sure"])

    placed = cut(keyed.mapInArrow(place, f"id {kind}, key binary, shard int, sure boolean"))
    none = F.lit(None)
    both = placed.where("not sure").select("shard", F.lit(1).alias("ord"), none.cast("binary").alias("twice"), "id", "key").unionByName(filters.select("shard", F.lit(0).alias("ord"), "twice", none.cast(kind).alias("id"), none.cast("binary").alias("key")))

    def probe(batches):
        now, packed = None, None
        for batch in batches:
            shard, ord_, twice = (np.array(c.to_pylist(), object) for c in batch.columns[:3])
            again = np.zeros(len(shard), bool)
            edges = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (ord_[1:] != ord_[:-1]))).tolist() if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)]):
                if ord_[a] == 0:
                    now, packed = shard[a], np.frombuffer(twice[a], np.uint8)
                elif shard[a] == now:
                    again[a:b] = held(packed, positions(_hash64(batch.column(4).slice(a, b - a)), bits))
            rows = pa.array(ord_ == 1)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(again)], ["id", "key", "again"]).filter(rows)

    probed = both.repartition("shard").sortWithinPartitions("shard", "ord").mapInArrow(probe, out)
    return placed.where("sure").select("id", "key", F.lit(True).alias("again")).unionByName(probed)


def with_copies(keyed: DataFrame, hot: int = HOT, **filters: int) -> DataFrame:
    """Rows (id, first_id, n_copies): the smallest id of the row's group and the group's size.

    ``keyed`` has id and key (32 bytes); rows that come twice with one id count
    once. Only rows that the filters (:func:`mark_repeats`) let through are
    shuffled by key, distinct and pre-aggregated. The first id of a group of
    over max(``hot``, a ``hot``-th of those rows) goes to its rows by
    broadcast - there are at most ``hot`` such groups -, that of the others by a
    join in which no key is larger. Nulls in id or key: the row is left out.
    """
    keyed = cut(keyed.where("id is not null and key is not null").select("id", "key"))
    marked = cut(mark_repeats(keyed, keyed.count(), **filters))
    single = marked.where("not again").select("id", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("n_copies"))
    rows = marked.where("again").select("id", "key").distinct()
    groups = cut(rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")))
    total = groups.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    large = max(hot, total // hot)
    if groups.where(F.col("n_copies") > large).isEmpty():
        return single.unionByName(rows.join(groups, "key").select("id", "first_id", "n_copies"))
    top = groups.where(F.col("n_copies") > large).select("key", F.struct("first_id", "n_copies").alias("top"))
    rows = rows.join(F.broadcast(top), "key", "left")
    cold = rows.where("top is null").select("id", "key").join(groups, "key").select("id", "first_id", "n_copies")
    return single.unionByName(rows.where("top is not null").select("id", "top.first_id", "top.n_copies")).unionByName(cold)


def entry_copies(entries: DataFrame) -> DataFrame:
    """knowledge_entries as (id, first_id, n_copies); one entry of each group has id = first_id.

    Equal but for white space, letter case, width, punctuation, symbols and the
    order of the body's lines; a null title equals an empty one. Entries whose
    body is null or blank are left out.
    """
    whole = entries.where(~blank(F.col("body")))
    return with_copies(whole.select("id", canonical_key(F.col("title"), F.col("body")).alias("key")))
