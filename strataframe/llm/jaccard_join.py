"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

1. One pass gives each document its set of five-word shingles (A-Z folded), a
   hash of the set and a signature: ``TREES`` labels of ``DEPTH`` values each.
   Documents with equal sets form one representative.
2. Every tree is a prefix trie of sorted labels. Representatives that share
   ``floor`` values meet in one task, sorted by label, and their part of the
   trie is walked from the longest prefix up. A node compares those of its
   members that still ask with all others under it, by signature, and joins
   the near ones (well under the threshold) by spanning links. A member stops
   asking as soon as the recall estimated from its own candidates reaches the
   target: the links of their similarities that this depth would miss, and one
   unseen link at the threshold. So prefixes of documents in dense groups stay
   long, and those of documents with few or weak candidates are shortened, to
   the depth whose recall at the threshold reaches the target and below.
3. Candidate links are closed to clusters. Shingle sets of clusters are built
   again from the texts and compared exactly, all pairs of a cluster, block
   against block, in numpy: rows leaving a block are counts and a spanning
   forest, never pairs.

A node over ``CROWD`` members compares each with leaders (a member that is
near no earlier leader becomes one), so its cost grows with members times
leaders; below the depth that reaches the target it compares those who still
ask with all. A group over ``HOT`` members is too large for one task: all pairs of
its members are compared by signature, block against block, so nothing in it
is lost; that costs the square of its size, in tasks of bounded memory.

Result: one row per document with its class (component of verified links) and
its number of links (documents at the threshold or more, copies included).

Defined cases: null or empty text has no shingles and no links; a text of one
to four words has one shingle of all of them; rows with a null doc_id are
classes of their own with a null class_id; rows that repeat doc_id and text
are copies and count as rows do; all rows of a doc_id with several texts have
one class, which joins those of its texts, and as n_links the sum of those of
its texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import ascii_lower, by_position, drop_stages, release_memory, shared_dir, slices, stage_mark, stage_table, text_buffer
from strataframe.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
TARGET_RECALL = 0.9995
#: Estimated similarity from which signatures count as candidates: over four
#: standard errors under the threshold.
CANDIDATE = 0.64
#: Members of a node beyond which they are compared with leaders.
CROWD = 512
#: Members of a group beyond which all its pairs are compared, in blocks of so many members.
HOT, HOT_BLOCK = 20_000, 4096
#: Members and shingles of a block of the exact comparison.
BLOCK, BLOCK_SHINGLES = 256, 400_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base)
    p[:1] = 1
    return np.multiply.accumulate(p)


#: Bytes that are hashed at once; a longer text is cut at white space.
_PART = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def word_hashes(data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a text buffer, and each text's first word."""
    starts, hashes, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(data):
        blank = _BLANK.search(data, lo + _PART)
        hi = blank.start() if blank else len(data)
        start, h = _hash_words(data[lo:hi], off[(off >= lo) & (off <= hi)] - lo)
        starts.append(start + lo)
        hashes.append(h)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def _hash_words(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)  # a text also ends a word
    edge[edges] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=acc[1:])
    h = (acc[end] - acc[start]) * _powers(_P_INV, n)[start]
    return start, _mix(h + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted set of hashed shingles of one text's word hashes."""
    if not len(words):
        return words
    k = min(size, len(words))
    h = words[: len(words) - k + 1].copy()
    for i in range(1, k):
        h = h * _P + words[i : len(words) - k + 1 + i]
    return np.unique(_mix(h + np.uint64(k)))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a shingle set."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 8192):
        part = x[lo : lo + 8192]
        np.minimum(low, ((part[None, :] ^ b[:, None]) * a[:, None]).min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype(np.uint16)


def features(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, set_hash (null: no shingles), signature and number of shingles of every row."""

    def run(batches):
        a, b = _seeds(trees * depth)
        for whole in batches:
            for part in slices(whole, 1):
                data, off = text_buffer(part.column(1))
                words, first = word_hashes(ascii_lower(data), off)
                hashes, sigs, sizes = [], [], []
                for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                    sizes.append(0)
                    if i == j:
                        hashes.append(None)
                        sigs.append(None)
                        continue
                    s = shingles(words[i:j])
                    sizes[-1] = len(s)
                    key = np.array([len(s), _mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(s * _P)], np.uint64)
                    hashes.append(key.tobytes())
                    sigs.append(signature(s, a, b).tobytes())
                yield pa.record_batch([part.column(0), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "set_hash", "signature", "n_shingles"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, set_hash binary, signature binary, n_shingles long")


def recall_at(similarity, depth: int, trees: int = TREES):
    """Chance that a pair of this similarity shares a prefix of ``depth`` in some tree."""
    return 1.0 - (1.0 - similarity**depth) ** trees


def first_depth(threshold: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix whose recall at the threshold reaches the target."""
    while depth > 1 and recall_at(threshold, depth, trees) < target:
        depth -= 1
    return depth


def _labels(reps: DataFrame, floor: int, trees: int, depth: int) -> DataFrame:
    """rep, key, label: one row per tree, a key of the tree and its first ``floor`` values, and the other values."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(n, trees, depth)
            h = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (n, trees)).copy()
            for k in range(floor):
                h = _mix(h * _P + sig[:, :, k].astype(np.uint64))
            rest = sig[:, :, floor:].astype(">u2").tobytes()
            width = 2 * (depth - floor)
            offsets = np.arange(0, n * trees * width + 1, width, dtype=np.int32) if width else np.zeros(n * trees + 1, np.int32)
            label = pa.Array.from_buffers(pa.binary(), n * trees, [None, pa.py_buffer(offsets), pa.py_buffer(rest)])
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), trees)), pa.array(h.reshape(-1).view(np.int64)), label], names=["rep", "key", "label"])

    return reps.select("rep", "signature").mapInArrow(run, "rep long, key long, label binary")


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each node's component in a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _runs(batches, key_cols: int):
    """Rows of consecutive batches with equal leading columns, as lists of columns."""
    held, key = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        keys = list(zip(*cols[:key_cols]))
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                part = [c[at:i] for c in cols]
                if held is not None and key == keys[at]:
                    held = [x + y for x, y in zip(held, part)]
                else:
                    if held is not None:
                        yield held
                    held, key = part, keys[at]
                at = i
    if held is not None:
        yield held


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values of every row of a with every row of b."""
    step = max(1, (1 << 23) // max(b.size, 1))
    return np.concatenate([(a[i : i + step, None, :] == b[None]).sum(axis=2, dtype=np.uint16) for i in range(0, len(a), step)]).astype(np.float32) / a.shape[1]


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each component, after the components of a and b became one."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        least, to = np.minimum(a, b), np.arange(len(root))
        np.minimum.at(to, a, least)
        np.minimum.at(to, b, least)
        while (to[to] != to).any():
            to = to[to]
        root = to[root]


def _tiles(left: np.ndarray, right: np.ndarray):
    """Parts of bounded size that together hold every pair of left and right."""
    for i in range(0, len(left), 256):
        for j in range(0, len(right), 1024):
            yield left[i : i + 256], right[j : j + 1024]


class Walk:
    """One group of a tree: members that share a prefix of ``start`` values, sorted by label.

    ``links`` gets the spanning links (positions of members), ``stopped`` the
    depth at which each member stopped asking.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sig: np.ndarray, start: int, trees: int, threshold: float, target: float):
        self.ids, self.labels, self.sig, self.start, self.trees, self.threshold, self.target = ids, labels, sig, start, trees, threshold, target
        n, width = labels.shape
        self.top = start + width
        self.base = first_depth(threshold, target, trees, self.top)
        self.bins = np.linspace(threshold, 1.0, 9)
        self.seen = np.zeros((n, len(self.bins)), np.int64)  # candidates met, by similarity
        self.asks, self.child = np.ones(n, bool), np.arange(n)
        self.stopped = np.full(n, start)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self) -> Walk:
        for depth in range(self.top, self.start - 1, -1):
            used = self.labels[:, : depth - self.start]
            node = np.concatenate([[0], np.cumsum((used[1:] != used[:-1]).any(axis=1))])
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                if self.child[lo] != self.child[hi - 1] and self.asks[lo:hi].any():
                    if hi - lo <= CROWD:
                        self._all(lo, hi)
                    elif depth >= self.base:
                        self._leaders(lo, hi)
                    else:
                        self._asking(lo, hi)
            self.child = node
            p = recall_at(self.bins, depth, self.trees)
            found = self.seen.sum(axis=1)
            missed = self.seen @ ((1 - p) / p) + (1 - recall_at(self.threshold, depth, self.trees))
            stops = self.asks & (found / np.maximum(found + missed, 1e-12) >= self.target)
            self.stopped[stops] = depth
            self.asks &= ~stops
            if not self.asks.any():
                break
        return self

    def _count(self, rows: np.ndarray, sims: np.ndarray, other: np.ndarray) -> None:
        r, c = np.nonzero(other & (sims >= self.threshold))
        np.add.at(self.seen, (rows[r], np.searchsorted(self.bins, sims[r, c], "right") - 1), 1)

    def _all(self, lo: int, hi: int) -> None:
        ask = lo + np.flatnonzero(self.asks[lo:hi])
        sims = _agree(self.sig[ask], self.sig[lo:hi])
        other = self.child[ask][:, None] != self.child[None, lo:hi]
        self._count(ask, sims, other)
        near = np.zeros((hi - lo, hi - lo), bool)
        near[ask - lo] = other & (sims >= CANDIDATE)
        self._span(lo, _roots(near | near.T))

    def _asking(self, lo: int, hi: int) -> None:
        """As ``_all``, in parts: those who still ask are few, the others many and mostly not near each other."""
        root = np.arange(hi - lo)
        for ask, to in _tiles(lo + np.flatnonzero(self.asks[lo:hi]), np.arange(lo, hi)):
            sims = _agree(self.sig[ask], self.sig[to])
            other = self.child[ask][:, None] != self.child[None, to]
            self._count(ask, sims, other)
            r, c = np.nonzero(other & (sims >= CANDIDATE))
            root = _merged(root, ask[r] - lo, to[c] - lo)
        self._span(lo, root)

    def _span(self, lo: int, root: np.ndarray) -> None:
        """Link all members of each component to the one of least id, which other trees often choose too."""
        order = np.lexsort((self.ids[lo : lo + len(root)], root))
        first = np.ones(len(root), bool)
        first[1:] = root[order][1:] != root[order][:-1]
        least = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        own = order != least
        self.links.append((lo + order[own], lo + least[own]))

    def _leaders(self, lo: int, hi: int) -> None:
        leaders = np.zeros(0, np.int64)
        for at in range(lo, hi, 256):
            rest = np.arange(at, min(at + 256, hi))
            if len(leaders):
                rest = rest[_agree(self.sig[rest], self.sig[leaders]).max(axis=1) < CANDIDATE]
            near, covered, new = _agree(self.sig[rest], self.sig[rest]) >= CANDIDATE if len(rest) else None, np.zeros(len(rest), bool), []
            for i in range(len(rest)):
                if not covered[i]:
                    new.append(rest[i])
                    covered |= near[i]
            leaders = np.concatenate([leaders, np.array(new, np.int64)])
        nearest, shared = np.zeros(hi - lo, np.int64), [np.zeros(0, np.int64)]
        for at in range(lo, hi, 256):
            rows = np.arange(at, min(at + 256, hi))
            sims = _agree(self.sig[rows], self.sig[leaders])
            self._count(rows, sims, self.child[rows][:, None] != self.child[leaders][None])
            near = sims >= CANDIDATE
            nearest[rows - lo] = near.argmax(axis=1)  # a leader is near itself
            r, c = np.nonzero(near)
            same = r[1:] == r[:-1]  # leaders that share a member
            shared.append(np.unique(c[:-1][same] * len(leaders) + c[1:][same]))
        a, b = np.divmod(np.unique(np.concatenate(shared)), len(leaders))
        root = np.arange(len(leaders))
        while True:
            least = np.minimum(root[a], root[b])
            moved = root.copy()
            np.minimum.at(moved, a, least)
            np.minimum.at(moved, b, least)
            moved = moved[moved]
            if (moved == root).all():
                break
            root = moved
        self._span(lo, root[nearest])


def _walk_groups(start: int, trees: int, threshold: float, target: float):
    """Spanning links of each group's sub-trie; rows come sorted by key and label."""

    def run(batches):
        u, v, held = [], [], 0
        for _, labels, reps, sigs in _runs(batches, 1):
            if len(set(reps)) < 2:
                continue
            ids = np.array(reps, np.int64)
            sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(ids), -1)
            if len(ids) == 2:
                links = [(np.array([0]), np.array([1]))] if (sig[0] == sig[1]).mean() >= CANDIDATE else []
            else:
                label = np.frombuffer(b"".join(labels), ">u2").reshape(len(ids), -1)
                links = Walk(ids, label, sig, start, trees, threshold, target).run().links
            for a, b in links:
                u.append(ids[a])
                v.append(ids[b])
                held += len(a)
            if held >= 50_000:
                yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
                u, v, held = [], [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
        release_memory()

    return run


def _walk_blocks(batches):
    """Spanning links of all near pairs of two blocks of a hot group (or inside one)."""
    for _, bi, bj, sides, reps, sigs in _runs(batches, 3):
        ids, own = np.unique(np.array(reps, np.int64), return_index=True)
        sig = np.frombuffer(b"".join(sigs), np.uint16).reshape(len(reps), -1)[own]
        side = np.array(sides)[own]
        left, right = (np.arange(len(ids)),) * 2 if bi[0] == bj[0] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        root = np.arange(len(ids))
        for rows, cols in _tiles(left, right):
            if (root[rows] == root[cols[0]]).all() and (root[cols] == root[cols[0]]).all():
                continue  # they are one already
            r, c = np.nonzero(_agree(sig[rows], sig[cols]) >= CANDIDATE)
            root = _merged(root, rows[r], cols[c])
        linked = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.record_batch([pa.array(ids[linked]), pa.array(ids[root[linked]])], names=["u", "v"])
    release_memory()


def candidate_links(reps: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """u, v: links that join all representatives that the forest finds near each other."""
    floor = max(1, first_depth(threshold, target, trees, depth) - 1)
    labels, sigs = stage_table(_labels(reps, floor, trees, depth), "labels"), reps.select(F.col("rep").alias("s_rep"), "signature")
    shared = stage_table(labels.groupBy(F.col("key").alias("g_key")).agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    members = labels.join(shared.hint("shuffle_merge"), F.col("key") == F.col("g_key")).select("key", "label", "rep", "n")
    here = members.filter(F.col("n") <= HOT).select("key", "label", "rep").join(sigs, F.col("rep") == F.col("s_rep")).select("key", "label", "rep", "signature")
    near = here.repartition("key").sortWithinPartitions("key", "label").mapInArrow(_walk_groups(floor, trees, threshold, target), "u long, v long").distinct()
    if (shared.agg(F.max("n")).first()[0] or 0) <= HOT:
        return near
    hot = members.filter(F.col("n") > HOT).select("key", "rep", F.ceil(F.col("n") / HOT_BLOCK).cast("int").alias("blocks")).join(sigs, F.col("rep") == F.col("s_rep"))
    dealt = hot.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = dealt.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "signature")
    whole = pairs.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj").mapInArrow(_walk_blocks, "u long, v long")
    return near.unionByName(whole.distinct())


def _common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets (of a with itself when b is None)."""
    sets = a if b is None else a + b
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1
    place = np.cumsum(often) - 1
    keep = often[value]
    owner, value = owner[keep], place[value[keep]]
    width = int(often.sum())
    na = len(a)
    out = np.zeros((na, na if b is None else len(b)), np.float32)
    for lo in range(0, width, 8192):
        here = (value >= lo) & (value < lo + 8192)
        m = np.zeros((len(sets), min(8192, width - lo)), np.float32)
        m[owner[here], value[here] - lo] = 1.0
        out += m[:na] @ (m if b is None else m[na:]).T
    return out


def _verify(threshold: float):
    def run(batches):
        for cluster, bi, bj, side, reps, weights, sets in _runs(batches, 3):
            once = list({r: k for k, r in enumerate(reps)}.values())  # parts of a split partition may send a repeated row each
            side, reps, weights, sets = ([x[k] for k in once] for x in (side, reps, weights, sets))
            ids, w = np.array(reps, np.int64), np.array(weights, np.int64)
            arrays = [np.frombuffer(x, np.uint64) for x in sets]
            n = np.array([len(x) for x in arrays], np.float64)
            if bi[0] == bj[0]:
                inter = _common(arrays, None)
                jac = inter / (n[:, None] + n[None, :] - inter)
                np.fill_diagonal(jac, 0.0)
            else:
                left = np.flatnonzero(np.array(side) == 0)
                right = np.flatnonzero(np.array(side) == 1)
                if not len(left) or not len(right):
                    continue
                inter = _common([arrays[i] for i in left], [arrays[i] for i in right])
                half = inter / (n[left][:, None] + n[right][None, :] - inter)
                jac = np.zeros((len(ids), len(ids)))
                jac[np.ix_(left, right)] = half
                jac[np.ix_(right, left)] = half.T
            linked = jac >= threshold - 1e-9
            root = _roots(linked)
            yield pa.record_batch([pa.array(ids), pa.array(linked @ w), pa.array(ids[root])], names=["rep", "links", "root"])
        release_memory()

    return run


_VERIFIED = "rep long, links long, root long"


def _sets(batches):
    last = None
    for whole in batches:
        # rows come sorted by representative, so a repeated row follows its first one
        reps = [last, *whole.column(1).to_pylist()]
        last = reps[-1]
        whole = whole.filter(pa.array([a != b for a, b in zip(reps, reps[1:])], pa.bool_()))
        for b in slices(whole, whole.num_columns - 1):
            data, off = text_buffer(b.column(b.num_columns - 1))
            words, first = word_hashes(ascii_lower(data), off)
            sets = [shingles(words[i:j]).tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.record_batch([*b.columns[:-1], pa.array(sets, pa.binary())], names=["cluster", "rep", "size", "blocks", "shingles"])
    release_memory()


def verified(docs: DataFrame, reps: DataFrame, links: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per representative and block: its links and its root there."""
    clusters = components(links)
    members = clusters.join(reps.select("rep", "size", "n_shingles"), F.col("node") == F.col("rep")).select(F.col("root").alias("cluster"), "rep", "size", "n_shingles")
    # clusters of one block, nearly all, need no row here; a table of its own lets Spark see how small it is
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    large = members.groupBy(F.col("cluster").alias("l_cluster")).agg(blocks.alias("n_blocks")).filter("n_blocks > 1").checkpoint()
    members = members.join(large, F.col("cluster") == F.col("l_cluster"), "left").select("cluster", "rep", "size", F.coalesce("n_blocks", F.lit(1)).alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a merge join, so that rows come sorted by rep
    sets = members.hint("merge").join(texts, F.col("rep") == F.col("doc_id")).select("cluster", "rep", "size", "blocks", "text").mapInArrow(_sets, "cluster long, rep long, size long, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        sets.withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("cluster", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "size", "shingles")
    )
    return dealt.repartition("cluster", "bi", "bj").sortWithinPartitions("cluster", "bi", "bj").mapInArrow(_verify(threshold), _VERIFIED)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links of every row."""
    shared_dir(docs.sparkSession)
    rows = _row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    row = F.when(F.col("doc_id").isNotNull(), F.col("row"))
    found = _classes(rows.select(row.alias("doc_id"), "text"), threshold, target_recall, trees, depth)
    made = rows.filter(F.col("doc_id").isNotNull() & (F.col("row") != F.col("doc_id"))).select("row", F.col("doc_id").alias("own_id")).distinct().checkpoint()
    if made.isEmpty():
        return found
    # doc_ids with several texts: their rows have ids of their own up to here
    own = found.withColumnRenamed("doc_id", "id").join(made, F.col("id") == F.col("row"), "left").select("id", F.coalesce("own_id", "id").alias("doc_id"), "class_id", "n_links")
    theirs = own.join(made.select(F.col("own_id").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct().checkpoint()
    sums = theirs.groupBy("doc_id").agg(F.sum("n_links").alias("links"), F.min("class_id").alias("least"))
    joined = components(theirs.join(sums, "doc_id").filter("class_id != least").select(F.col("class_id").alias("u"), F.col("least").alias("v")))
    return own.join(sums.select("doc_id", "links"), "doc_id", "left").join(joined, F.col("class_id") == F.col("node"), "left").select("doc_id", F.coalesce("root", "class_id").alias("class_id"), F.coalesce("links", "n_links").alias("n_links"))


def _classes(docs: DataFrame, threshold: float, target_recall: float, trees: int, depth: int) -> DataFrame:
    """``jaccard_classes`` of rows of which those with one doc_id have one text."""
    feats = stage_table(features(docs, trees, depth), "shingle-features")
    some = feats.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets have equal signatures, so any one of them serves
    one = [F.first(c).alias(c) for c in ("signature", "n_shingles")]
    reps = stage_table(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), *one), "representatives")
    before = stage_mark()
    found = stage_table(verified(docs, reps, candidate_links(reps, threshold, target_recall, trees, depth), threshold), "verified-links")
    drop_stages(docs.sparkSession, before, stage_mark() - 1)  # labels and groups have been read
    classes = components(found.filter("root != rep").select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = (
        reps.select(F.col("set_hash").alias("own_hash"), "rep", "size")
        .join(links.withColumnRenamed("rep", "l_rep"), F.col("rep") == F.col("l_rep"), "left")
        .join(classes, F.col("rep") == F.col("node"), "left")
        .select("own_hash", F.coalesce("root", "rep").alias("own_class"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("own_links"))
    )
    joined = some.select("doc_id", "set_hash").join(own.hint("shuffle_merge"), F.col("set_hash") == F.col("own_hash"))
    alone = feats.filter(F.col("set_hash").isNull() | F.col("doc_id").isNull())
    return joined.select("doc_id", F.col("own_class").alias("class_id"), F.col("own_links").alias("n_links")).unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _row_ids(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``rows`` with ``row``, an id of each distinct pair of doc_id and text.

    It is the doc_id, but for null ids, and for all texts but one of a doc_id
    with several; those get ids of 2^62 or more from a hash of both.
    """
    own, body = F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.xxhash64(body)
    per_id = rows.select(own.alias("id"), hashed.alias("text")).filter("id IS NOT NULL").groupBy("id").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    several = per_id.filter("least != most").select("id", "least").checkpoint()  # nearly always empty; a table of its own lets Spark see it
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(own.cast("string"), F.lit("")), body), 2).bitwiseOR(F.lit(1 << 62))
    if several.isEmpty():  # no join then, which would shuffle the texts
        return rows.select(*rows.columns, F.when(own.isNull(), made).otherwise(own).alias("row"))
    row = F.when(own.isNull() | (F.col("least") != hashed), made).otherwise(own)
    return rows.join(several, own == F.col("id"), "left").select(*rows.columns, row.alias("row"))


def keep_one_per_class(docs: DataFrame, **kw) -> DataFrame:
    """Exactly one row of each class of near copies, columns unchanged: the one of the least doc_id.

    Rows are told apart by doc_id and text: null ids take part and come after
    all others, repeated rows stay once, and of a doc_id with several texts
    only those go that have a copy elsewhere; extra columns may have any name;
    texts without words and an empty table stay as they are.
    """
    shared_dir(docs.sparkSession)
    names, wide = docs.columns, by_position(docs)
    text = f"c{names.index('text')}"
    rows = _row_ids(wide, f"c{names.index('doc_id')}", text)
    classes = _classes(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text")), **{"threshold": THRESHOLD, "target_recall": TARGET_RECALL, "trees": TREES, "depth": DEPTH} | kw)
    gone = classes.filter(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("gone")).distinct()
    return rows.dropDuplicates(["row"]).join(gone, F.col("row") == F.col("gone"), "left_anti").select(*wide.columns).toDF(*names)
