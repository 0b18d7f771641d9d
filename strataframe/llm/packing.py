"""Best-fit packing with certified repacking.

Documents are tokenised once; only those longer than a sequence are cut. Piece
lengths are dealt to partitions by a hash, and each partition packs its pieces
by best-fit decreasing. Dual feasible functions (the identity, the threshold
family and the rounding family) bound the number of bins a partition needs
from below. A partition that meets its bound is certified and keeps all but
its poorly filled bins; a partition with a gap gives up the documents of all
bins that waste more than a few tokens. What was given up is dealt anew over
fewer partitions and packed again, until nothing is given up, one partition is
left, or a round frees less than a fifth of what it was given: then the gap no
longer shrinks. Every piece carries the certificate of the packing it settled
in: the bins that its partition used and the bound below which no packing of
the same pieces can go. Only lengths move between rounds, never texts.

Defined cases: null or empty text is a document of the end id alone; a null
doc_id is packed like any other; repeated rows are packed each; a document of
exactly one sequence is not cut; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import drop_stages, slices, stage_mark, stage_table
from strataframe.llm._tokens import encoder

CAPACITY = 4096
#: Pieces a partition packs at once.
PER_PARTITION = 40_000
#: Share of a round's pieces beyond which what is left is not packed again.
STALLED = 0.8
#: Chunks a worker remembers; it keeps them while other stages run.
CACHE = 400_000
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        enc = encoder(tokenizer, end_id, CACHE)
        for whole in batches:
            for b in slices(whole, 1):
                ids, n = enc.encode_column(b.column(1))
                cuts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                length = np.minimum(n[row] - piece * capacity, capacity)
                base = (np.cumsum(n) - n)[row] + piece * capacity
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(base.tolist(), (base + length).tolist())]
                yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64())], schema=_PIECE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECE_DDL)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by best-fit decreasing, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            own = room[space].pop()
            if not room[space]:
                mask ^= 1 << space
        else:
            own, space, used = used, capacity, used + 1
        where[i], offset[i] = own, capacity - space
        left = space - size
        if left:
            if not room[left]:
                mask |= 1 << left
            room[left].append(own)
    return where, offset, used


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual feasible functions."""
    if not len(lengths):
        return 0
    hist = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((hist * x).sum()) // capacity)
    count, mass = np.cumsum(hist), np.cumsum(hist * x)
    eps = np.arange(1, capacity // 2 + 1)  # items over capacity - eps count whole, those under eps not at all
    whole = count[-1] - count[capacity - eps]
    middle = mass[capacity - eps] - mass[eps - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 25):  # f(x) = x where (k + 1) x / C is whole, else floor((k + 1) x / C) / k, in units of 1 / (k (k + 1))
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        value = np.where(exact, k * (scaled // capacity), (k + 1) * (scaled // capacity))
        best = max(best, -(-int((hist * value).sum()) // (k * (k + 1))))
    return best


_PACKED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bins", pa.int64()), ("bound", pa.int64()), ("settled", pa.bool_())])


def _pack_round(items: DataFrame, parts: int, number: int, last: bool, capacity: int) -> DataFrame:
    """Pack every partition; mark what a further round may improve as not settled."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        length = t.column("length").to_numpy()
        own, offset, used = best_fit(length, capacity)
        waste = capacity - np.bincount(own, length, minlength=used).astype(np.int64)
        bound = lower_bound(length, capacity)
        settled = np.ones(used, bool) if last else waste <= (capacity // 256 if used > bound else capacity // 16)
        part = t.column("part")[0].as_py()
        sequence = (number << 56) + (part << 26) + own
        same = lambda v: pa.array(np.full(len(own), v))
        return pa.table([*(t.column(f.name) for f in _PIECE), pa.array(sequence), pa.array(offset), same(used), same(bound), pa.array(settled[own])], schema=_PACKED)

    dealt = items.select(*_PIECE.names, F.pmod(F.xxhash64(F.lit(number), "doc_id", "piece", F.monotonically_increasing_id()), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(run, _PIECE_DDL + ", sequence_id long, offset long, bins long, bound long, settled boolean")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset, and the bins and bound of the partition that packed them."""
    before = stage_mark()
    todo = stage_table(pieces(docs, tokenizer, end_id, capacity), "pieces")
    out, n, number = None, todo.count(), 0
    while True:
        parts = max(1, math.ceil(n / per_partition))
        packed = stage_table(_pack_round(todo, parts, number, parts == 1, capacity), f"packed{number}")
        if number == 0:
            drop_stages(docs.sparkSession, before, before + 1)  # the pieces are in the packed table now
        left = packed.filter("NOT settled")
        more = 0 if parts == 1 else left.count()
        over = more == 0 or more > STALLED * n
        done = (packed if over else packed.filter("settled")).drop("settled")
        out = done if out is None else out.unionByName(done)
        if over:
            return out
        todo, n, number = left.select(*_PIECE.names), more, number + 1
