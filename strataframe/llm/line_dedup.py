"""Line deduplication over a sharded minimal perfect hash.

Documents are cut into slices of bounded size; every slice sends its distinct
line hashes (128 bits) and in how many of its documents each occurs. Hashes
are dealt over shards by their leading bits. A shard becomes a minimal perfect
hash over its distinct line hashes (levels of bit arrays: a hash is placed on
the first level where no other one has its bit), whose slots index an array of
32-bit fingerprints and one of document counts: about 8.5 bytes a distinct
line, whatever its length. A slice then sends its hashes, packed, to the
shards, which look them up and answer with the frequent ones; lines are never
joined. Every document drops its lines among its slice's answers.

No shard or slice grows with a hot line or a hot document: a line reaches its
shard once a task when counting and once a slice when probing.

Defined cases: null or empty text is one empty line; rows are documents, so
rows that repeat id and text count each; a line's key has spaces, tabs and line
controls stripped and A-Z lowered; lines with keys under ``min_chars`` code
points always stay; a text of which all lines go is empty; null ids are rows
like others; extra columns may have any name and come through; an empty table
stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strataframe.llm._common import ascii_lower, by_position, release_memory, slices, stage_table, text_buffer

_SPACE = b" \t\n\x0b\x0c\r"
#: Rows and bytes of text of a slice; a longer text is a slice by itself.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20
#: Line hashes that a shard is made for.
SHARD_KEYS = 1 << 18
#: Bits of a level for each hash that reaches it, and the most levels.
GAMMA, LEVELS = 1.5, 48


# ---- the index


def _levels_slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys[:, 0] ^ (keys[:, 1] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class LineIndex:
    """Minimal perfect hash of distinct 128-bit keys with a fingerprint and a count in every slot."""

    def __init__(self, sizes: list[int], bits: np.ndarray, rest: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.rest, self.fingerprints, self.counts = sizes, bits, rest, fingerprints, counts
        self.rank = np.cumsum(bits, dtype=np.uint32)
        self.start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> LineIndex:
        """``keys``: n distinct rows of two 64-bit words."""
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            slot = _levels_slot(left, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[slot]]
        index = cls(sizes, np.concatenate(bits).astype(np.uint8) if bits else np.zeros(0, np.uint8), left, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        slots = index.slots(keys)
        index.fingerprints[slots] = _fingerprint(keys)
        index.counts[slots] = np.minimum(counts, 0xFFFFFFFF)
        return index

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key that was not indexed finds none."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = self.start[level] + _levels_slot(keys[open_], level, size)
            hit = self.bits[at] == 1
            out[open_[hit]] = self.rank[at[hit]].astype(np.int64) - 1
            open_ = open_[~hit]
        placed = int(self.rank[-1]) if len(self.rank) else 0
        for k, key in enumerate(self.rest):  # what no level could tell apart: nearly always nothing
            out[open_[(keys[open_] == key).all(axis=1)]] = placed + k
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key; 0 where its fingerprint is not the slot's."""
        if not len(self.counts):
            return np.zeros(len(keys), np.uint32)
        slots = self.slots(keys)
        return np.where((slots >= 0) & (self.fingerprints[slots] == _fingerprint(keys)), self.counts[slots], 0)

    def fields(self) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        return np.array(self.sizes, "<u4").tobytes(), np.packbits(self.bits).tobytes(), self.rest.astype("<u8").tobytes(), self.fingerprints.astype("<u4").tobytes(), self.counts.astype("<u4").tobytes()

    @classmethod
    def of(cls, sizes: bytes, bits: bytes, rest: bytes, fingerprints: bytes, counts: bytes) -> LineIndex:
        sizes_ = np.frombuffer(sizes, "<u4").tolist()
        return cls(sizes_, np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes_)), np.frombuffer(rest, "<u8").reshape(-1, 2), np.frombuffer(fingerprints, "<u4"), np.frombuffer(counts, "<u4"))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 1] * np.uint64(0x9FB21C651E98DF25) >> np.uint64(32)).astype(np.uint32)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    return keys[first], np.add.reduceat(counts, first)


def _words(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u8").reshape(-1, 2)


# ---- lines of documents


def _counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or sum(c & 0xC0 != 0x80 for c in key) >= min_chars)


def _line_keys(body: bytes, min_chars: int) -> list[bytes | None]:
    """Hash of the key of every line of a text whose A-Z is lowered; None where the key is too short."""
    digest, out = xxhash.xxh3_128_digest, []
    for line in body.split(b"\n"):
        key = line.strip(_SPACE)
        out.append(digest(key) if _counted(key, min_chars) else None)
    return out


def _slice_lines(at: int, min_chars: int):
    """Rows with the number of their slice, then a row of the slice's line hashes and counts."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in slices(whole, at, SLICE_ROWS, SLICE_BYTES):
                data, off = text_buffer(b.column(at).cast(pa.string()))
                data, found = ascii_lower(data), []
                for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
                    keys = set(_line_keys(data[i:j], min_chars))
                    keys.discard(None)
                    found.extend(keys)
                keys, counts = _merged(_words(b"".join(found)), np.ones(len(found), np.int64))
                names = ["slice", "keys", "counts", *b.schema.names]
                nulls = [pa.nulls(b.num_rows, pa.binary())] * 2
                yield pa.record_batch([pa.array([number] * b.num_rows, pa.int64()), *nulls, *b.columns], names=names)
                packed = [pa.array([keys.astype("<u8").tobytes()], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
                yield pa.record_batch([pa.array([number], pa.int64()), *packed, *[pa.nulls(1, c.type) for c in b.columns]], names=names)
                number += 1
        release_memory()

    return run


def sliced(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A stage table of the rows (columns by position) with slice numbers, and of each slice's hashes."""
    wide = by_position(docs)
    schema = StructType([StructField("slice", LongType()), StructField("keys", BinaryType()), StructField("counts", BinaryType()), *[StructField(f.name, f.dataType) for f in wide.schema.fields]])
    return stage_table(wide.mapInArrow(_slice_lines(docs.columns.index("text"), min_chars), schema), "sliced-lines")


# ---- building and probing the index


def _cut(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that occur among sorted keys, and where each begins (one more at the end)."""
    shard = ((keys[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    numbers, first = np.unique(shard, return_index=True)
    return numbers, np.append(first, len(keys))


def _counts_by_shard(shards: int):
    """(shard, keys, counts), merged over all the slices of a task as far as SHARD_KEYS goes."""

    def parts(held):
        keys, counts = _merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        numbers, first = _cut(keys, shards)
        for lo in range(0, len(numbers), 1024):
            span = [(first[i], first[i + 1]) for i in range(lo, min(lo + 1024, len(numbers)))]
            yield pa.record_batch(
                [pa.array(numbers[lo : lo + 1024], pa.int64()), pa.array([keys[i:j].tobytes() for i, j in span], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in span], pa.binary())],
                names=["shard", "keys", "counts"],
            )

    def run(batches):
        held, size = [], 0
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if keys:
                    held.append((_words(keys), np.frombuffer(counts, "<i8")))
                    size += len(held[-1][0])
                if size > 4 * SHARD_KEYS:
                    yield from parts(held)
                    held, size = [], 0
        if held:
            yield from parts(held)
        release_memory()

    return run


_INDEX = "shard long, sizes binary, bits binary, rest binary, fingerprints binary, line_counts binary"


def _built(group: pa.Table) -> pa.Table:
    keys = np.concatenate([_words(k) for k in group.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, "<i8") for c in group.column("counts").to_pylist()])
    index = LineIndex.build(*_merged(keys, counts))
    cols = [pa.array([group.column("shard")[0].as_py()], pa.int64()), *[pa.array([f], pa.binary()) for f in index.fields()]]
    return pa.table(cols, names=["shard", "sizes", "bits", "rest", "fingerprints", "line_counts"])


def n_shards(lines: DataFrame) -> int:
    """As many shards as give each SHARD_KEYS hashes or fewer."""
    return int((lines.agg(F.sum(F.length("keys"))).first()[0] or 0) // (16 * SHARD_KEYS)) + 1


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the minimal perfect hash of its line hashes, their fingerprints and document counts.

    ``lines``: rows with ``keys`` and ``counts``. Hashes that one task saw in
    many slices reach their shard once, so a shard is bounded by its distinct
    hashes and, for each, the number of tasks.
    """
    dealt = lines.select("keys", "counts").mapInArrow(_counts_by_shard(shards), "shard long, keys binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(_built, _INDEX)


def _asks(shards: int):
    """(shard, slice, keys) of every slice."""

    def run(batches):
        for b in batches:
            for number, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = _words(value)
                numbers, first = _cut(keys, shards)
                yield pa.record_batch(
                    [pa.array(numbers, pa.int64()), pa.array([number] * len(numbers), pa.int64()), pa.array([keys[i:j].tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())],
                    names=["shard", "slice", "keys"],
                )

    return run


def _answers(min_docs: int):
    """Of each ask behind the row of its shard's index: the keys in ``min_docs`` documents at least."""

    def run(batches):
        index, shard = None, None
        for b in batches:
            numbers, hits = [], []
            for at, number, keys, *fields in zip(*(c.to_pylist() for c in b.columns)):
                if number is None:
                    index, shard = LineIndex.of(*fields), at
                elif at == shard:
                    asked = _words(keys)
                    often = asked[index.find(asked) >= min_docs]
                    if len(often):
                        numbers.append(number)
                        hits.append(often.tobytes())
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(hits, pa.binary())], names=["slice", "hits"])
        release_memory()

    return run


def frequent(lines: DataFrame, index: DataFrame, shards: int, min_docs: int = 10) -> DataFrame:
    """(slice, hits): of each slice's hashes those whose count in ``index`` is ``min_docs`` or more.

    Asks stream past their shard's arrays, which come first in its partition; a
    shard's asks are never held together.
    """
    fields = ["sizes", "bits", "rest", "fingerprints", "line_counts"]
    asks = lines.select("slice", "keys").mapInArrow(_asks(shards), "shard long, slice long, keys binary")
    asks = asks.select("shard", "slice", "keys", *[F.lit(None).cast("binary").alias(c) for c in fields])
    arrays = index.select("shard", F.lit(None).cast("long").alias("slice"), F.lit(None).cast("binary").alias("keys"), *fields)
    met = asks.unionByName(arrays).repartition("shard").sortWithinPartitions("shard", F.col("slice").asc_nulls_first())
    return met.mapInArrow(_answers(min_docs), "slice long, hits binary")


# ---- documents


def _dropped(at: int, columns: list[str], min_chars: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = rows.combine_chunks(), answers.combine_chunks()
        often: set[bytes] = set()
        for value in answers.column("hits").to_pylist():
            often.update(value[i : i + 16] for i in range(0, len(value), 16))
        data, off = text_buffer(rows.column(columns[at]).cast(pa.string()))
        low, texts, n_lines, n_dropped = ascii_lower(data), [], [], []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
            keys = _line_keys(low[i:j], min_chars)
            gone = sum(k in often for k in keys)
            n_lines.append(len(keys))
            n_dropped.append(gone)
            texts.append(data[i:j] if not gone else b"\n".join(line for line, k in zip(data[i:j].split(b"\n"), keys) if k not in often))
        cols = [pa.array(texts, pa.binary()).cast(pa.string()) if c == columns[at] else rows.column(c) for c in columns]
        return pa.table([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return run


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The columns of ``docs`` by position (c0, c1, ..), the text without its frequent lines, and n_lines and n_dropped."""
    wide = by_position(docs)
    found = sliced(docs, min_chars)
    lines = found.filter(F.length("keys") > 0).select("slice", "keys", "counts")
    shards = n_shards(lines)
    index = stage_table(build_index(lines, shards), "line-index")
    hits = frequent(lines, index, shards, min_docs)
    rows = found.filter("keys IS NULL").select("slice", *wide.columns)
    schema = StructType([*[StructField(f.name, f.dataType) for f in wide.schema.fields], StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return rows.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(_dropped(docs.columns.index("text"), wide.columns, min_chars), schema)


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines gone from the texts, columns unchanged; a null text becomes empty."""
    return drop_frequent_lines(docs, min_docs, min_chars).drop("n_lines", "n_dropped").toDF(*docs.columns)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return drop_frequent_lines(rows, min_docs, min_chars).select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2("c1", 256).alias("kept_sha256"))
