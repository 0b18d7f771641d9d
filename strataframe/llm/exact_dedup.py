"""Exact deduplication by Patricia-trie owners.

Texts are lower-cased in A-Z only. Rows are partitioned by byte length and
content hash; every partition inserts the full byte strings into a compressed
radix trie whose terminal nodes hold the owning identifier and the number of
rows. Equality is therefore decided on bytes, never on a hash. A trie over its
budget spills its heaviest subtree: the keys leave the task as rows, and a
further round deals them over as many partitions as their bytes need.

Defined cases: null text counts as empty, all empty texts are one group; a
null doc_id never owns a group unless the whole group has null ids (owner
null, no row kept by id, so ``kept`` is true for the null rows); rows that
repeat both id and text are the same document and get the same decision; a
text longer than the budget is held whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strataframe.llm._common import ascii_lower, by_position, release_memory, stage_table, text_buffer

#: Bytes of labels a trie may hold before it spills its heaviest subtree.
TRIE_BUDGET = 96 << 20
#: What a node costs beside its label.
_NODE = 120


class _Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.kids, self.value = label, None, value


#: Marks the place of a spilled subtree.
_STUB = object()


def _split_at(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    lo = 0
    while lo < n and a[lo : lo + 64] == b[lo : lo + 64]:
        lo += 64
    lo = min(lo, n)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    return lo


class PatriciaTrie:
    """Compressed radix trie: key bytes -> payload merged by ``merge``.

    ``spill`` takes the heaviest subtree out and leaves a stub of one byte in
    its place; keys that reach a stub are refused, so a key is either wholly in
    the trie or wholly outside.
    """

    def __init__(self, merge, budget: int = TRIE_BUDGET):
        self.root, self.merge, self.budget, self.held = _Node(b""), merge, budget, 0

    def insert(self, key: bytes, value) -> bool:
        """False where the key belongs to a subtree that was spilled."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            kids = node.kids
            kid = kids.get(key[at]) if kids else None
            if kid is None:
                if kids is None:
                    node.kids = kids = {}
                kids[key[at]] = _Node(key[at:], value)
                self.held += n - at + _NODE
                return True
            if kid.value is _STUB:
                return False
            label = kid.label
            if key.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            cut = _split_at(label, key[at : at + len(label)])
            upper = _Node(label[:cut])
            kid.label = label[cut:]
            upper.kids = {kid.label[0]: kid}
            kids[label[0]] = upper
            self.held += _NODE
            node, at = upper, at + cut
        node.value = value if node.value is None else self.merge(node.value, value)
        return True

    def _walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        """Keys and payloads under a node; one path is held, not one a key."""
        path = bytearray(prefix)
        stack = [(node, len(prefix))]
        while stack:
            at, depth = stack.pop()
            del path[depth:]
            path += at.label
            if at.value is not None and at.value is not _STUB:
                yield bytes(path), at.value
            if at.kids:
                depth = len(path)
                stack.extend((k, depth) for k in at.kids.values())

    def _weight(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            at = stack.pop()
            total += len(at.label) + _NODE
            if at.kids:
                stack.extend(at.kids.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, object]] | None:
        """Keys and payloads of the heaviest subtree, taken out; None where there is no branch.

        The other branches stay, so what is spilled is always fewer keys than
        the trie was given, and a trie of one path (a single key, however long)
        spills nothing.
        """
        parent, prefix = self.root, b""
        while True:
            live = [k for k in (parent.kids or {}).values() if k.value is not _STUB]
            if len(live) != 1 or parent.value is not None:
                break
            parent, prefix = live[0], prefix + live[0].label  # one way only: go down to the first branch
        if not live:
            return None
        heavy = max(live, key=self._weight)
        self.held -= self._weight(heavy) - _NODE
        stub = parent.kids[heavy.label[0]] = _Node(heavy.label[:1])
        stub.value = _STUB
        return self._walk(heavy, prefix)

    def items(self) -> Iterator[tuple[bytes, object]]:
        return self._walk(self.root, b"")


def _merger(largest: bool):
    pick = max if largest else min

    def merge(a, b):
        own = b[0] if a[0] is None else a[0] if b[0] is None else pick(a[0], b[0])
        return own, a[1] + b[1], a[2]

    return merge


_LOCAL = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("owner_digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("body", pa.binary())])
_OWNERS_DDL = "owner_digest binary, keep_id long, group_size long, body binary"
_KEYS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = text_buffer(b.column(1))
        data = ascii_lower(data)
        sha = [hashlib.sha256(data[i:j]).digest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        yield pa.record_batch([b.column(0), pa.array(sha, pa.binary())], schema=_KEYS)


def _pre_aggregate(largest: bool):
    merge = _merger(largest)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            data, off = text_buffer(b.column(1))
            data = ascii_lower(data)
            seen: dict[bytes, tuple] = {}
            for own, i, j in zip(ids, off[:-1].tolist(), off[1:].tolist()):
                body = data[i:j]
                seen[body] = merge(seen[body], (own, 1, b"")) if body in seen else (own, 1, b"")
            keys = list(seen)
            sha = [hashlib.sha256(k).digest() for k in keys]
            for i in range(0, len(keys), 1000):
                part = keys[i : i + 1000]
                yield pa.record_batch(
                    [
                        pa.array([len(k) for k in part], pa.int64()),
                        pa.array(np.frombuffer(b"".join(s[:8] for s in sha[i : i + 1000]), np.int64)),
                        pa.array(sha[i : i + 1000], pa.binary()),
                        pa.array(part, pa.binary()),
                        pa.array([seen[k][0] for k in part], pa.int64()),
                        pa.array([seen[k][1] for k in part], pa.int64()),
                    ],
                    schema=_LOCAL,
                )

    return run


class _Rows:
    """Rows gathered to record batches of bounded size."""

    def __init__(self):
        self.cols, self.bytes = [[] for _ in _OWNERS], 0

    def add(self, value, body: bytes | None) -> None:
        own, n, sha = value
        for col, v in zip(self.cols, (sha, own, n, body)):
            col.append(v)
        self.bytes += 64 + (0 if body is None else len(body))

    def full(self) -> bool:
        return self.bytes > 1 << 20

    def take(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(v, t) for v, t in zip(self.cols, _OWNERS.types)], schema=_OWNERS)
        self.__init__()
        return out


def _own(largest: bool, budget: int):
    """Owners of the texts of a partition (body null), and the rows of spilled subtrees (with body)."""
    merge = _merger(largest)

    def run(batches):
        trie, rows = PatriciaTrie(merge, budget), _Rows()
        for b in batches:
            for sha, body, own, n in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5))):
                if not trie.insert(body, (own, n, sha)):
                    rows.add((own, n, sha), body)
                while trie.held > budget:
                    part = trie.spill()
                    if part is None:
                        break
                    for key, value in part:
                        rows.add(value, key)
                        if rows.full():
                            yield rows.take()
                if rows.full():
                    yield rows.take()
        for _, value in trie.items():
            rows.add(value, None)
            if rows.full():
                yield rows.take()
        yield rows.take()
        del trie
        release_memory()

    return run


def trie_owners(docs: DataFrame, keep: str = "min", budget: int = TRIE_BUDGET) -> DataFrame:
    """One row per distinct text: owner_digest (SHA-256 of the text), keep_id, group_size.

    Every batch sends a text once whatever its copies, so a group with a third
    of all rows reaches its trie as one row per batch. Every round finishes all
    that fits the tries; there is a next one only for what was spilled.
    """
    largest = keep == "max"
    local = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pre_aggregate(largest), "n_bytes long, content_hash long, digest binary, body binary, owner long, n long")
    dealt, done, number = local.repartition("n_bytes", "content_hash"), None, 0
    while True:
        found = stage_table(dealt.mapInArrow(_own(largest, budget), _OWNERS_DDL), f"owners{number}")
        own = found.filter("body IS NULL").drop("body")
        done = own if done is None else done.unionByName(own)
        spilled = found.filter("body IS NOT NULL")
        left = spilled.agg(F.sum(F.length("body"))).first()[0]
        if not left:
            return done
        number += 1
        rows = spilled.select(F.length("body").cast("long").alias("n_bytes"), F.xxhash64(F.lit(number), "owner_digest").alias("content_hash"), F.col("owner_digest").alias("digest"), "body", F.col("keep_id").alias("owner"), F.col("group_size").alias("n"))
        dealt = rows.repartition(int(left // max(budget // 4, 1 << 20)) + 1, "n_bytes", "content_hash")


def exact_dedup(docs: DataFrame, keep: str = "min", budget: int = TRIE_BUDGET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``keep``: the smallest ("min") or largest ("max") doc_id of equal texts
    stays. Documents find their owner by an equi-join on the digest, which
    adaptive execution splits where one text is hot.
    """
    keys = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, "doc_id long, digest binary")
    owners = trie_owners(docs, keep, budget)
    joined = keys.join(owners.hint("shuffle_merge"), keys.digest == owners.owner_digest)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _with_digests(at: int):
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column(at).cast(pa.string()))
            data = ascii_lower(data)
            sha = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.record_batch([*b.columns, pa.array(sha, pa.string())], names=[*b.schema.names, "sha"])

    return run


def keep_one_per_text(docs: DataFrame, keep: str = "min") -> DataFrame:
    """Exactly one row of each distinct text, columns unchanged.

    Decisions are carried by doc_id and text digest: a null id is dropped
    where its text has an owner, else one null row stays; repeated rows stay
    once; a doc_id with several texts loses only those that are copies; extra
    columns may have any name; an empty table stays empty.
    """
    names, wide = docs.columns, by_position(docs)
    own, at = F.col(f"c{names.index('doc_id')}"), names.index("text")
    key = lambda sha, doc_id: F.concat_ws(":", sha, doc_id.cast("long").cast("string"))
    schema = StructType([*wide.schema.fields, StructField("sha", StringType())])
    rows = wide.mapInArrow(_with_digests(at), schema).select(*wide.columns, key("sha", own).alias("key"))
    found = exact_dedup(wide.select(own.alias("doc_id"), F.col(f"c{at}").alias("text")), keep)
    gone = found.filter(~F.col("kept")).select(key("text_sha256", F.col("doc_id")).alias("gone")).distinct()
    return rows.dropDuplicates(["key"]).join(gone, F.col("key") == F.col("gone"), "left_anti").select(*wide.columns).toDF(*names)
