"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut before runs of spaces and around control characters, which no
piece crosses, and each distinct chunk is encoded once. Chunks of equal length
advance together: the hashes of all their substrings probe the sorted piece
keys, and for every end position the best piece that ends there is stored as a
back-pointer, by one vectorised maximum.

A unigram model maximises the sum of piece scores. A BPE model (such as the
public 32k file) is defined by its merge order, which no sum of scores
reproduces; there a piece may follow another only if merging the two texts
together gives exactly these two pieces. Exactly one piece that ends at a
position is admissible after its predecessor, because a sequence is the BPE
result if and only if each neighbouring pair is, so the same lattice and
back-pointers give the exact BPE encoding. Whether a pair is admissible is
found by merging its text (batched too) and remembered.

A long chunk, of a script without spaces or a long code, is cut where no piece
of the model that occurs in it crosses: the best sequence must part there too,
and its parts advance together with others of their length. What remains long
takes its substrings from windows, so memory does not grow with the chunk.

Unknown characters become byte pieces where the model has them, else the
unknown id. Defined cases: null or empty text has no ids and decodes to "";
a null doc_id passes through; repeated rows are encoded each; a model with a
normaliser other than identity or with user-defined pieces is refused with
``ValueError``; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import slices, text_buffer
from strataframe.llm._tokens import ChunkTable

SPACE = "▁"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_CELLS = 1 << 16  # characters of equal-length chunks that advance together
_LONG = 256  # characters beyond which a chunk is cut
_WINDOW = 1 << 14  # characters whose substrings are probed at once
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


class Model:
    """Pieces, scores and kind of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, kinds = [], [], []
        self.bpe, self.prefix = False, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, _NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models")
                self.bpe = kind == 2
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only models with identity normalisation")
                self.prefix = bool(f.get(3, 1))
        if _USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.kinds = np.array(kinds)
        self.scores = np.array(self.scores)
        self.unk = int(np.flatnonzero(self.kinds == _UNKNOWN)[0])
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == _BYTE}
        usable = np.flatnonzero(self.kinds == _NORMAL)
        texts = [self.pieces[i] for i in usable.tolist()]
        self.longest = max(map(len, texts))
        if any(a != SPACE and b == SPACE for t in texts for a, b in zip(t, t[1:])):
            raise ValueError("pieces that cross a space are not supported")
        self.barriers = sorted(set(range(1, 32)) - {ord(c) for t in texts for c in t if ord(c) < 32})
        keys = np.array([_key(t) for t in texts], _U)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], usable[order]
        if len(keys) > 1 and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")


def _key(text: str) -> int:
    h, p = 0, 1
    for c in text:
        h, p = (h + (ord(c) + 1) * p) & (2**64 - 1), p * _BASE & (2**64 - 1)
    return int(_finish(np.array([h], _U), len(text))[0])


def _finish(h: np.ndarray, n) -> np.ndarray:
    h = (h ^ (h >> _U(31)) ^ _U(n)) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


class Lattice:
    def __init__(self, model: Model):
        self.m = model
        self.none = len(model.pieces)  # stands for the text's begin, and for an unknown character
        # pairs judged so far: sorted keys with their verdicts, and the latest ones beside them
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        self.latest: dict[int, bool] = {}

    def spans(self, chars: np.ndarray) -> np.ndarray:
        """Piece id of chars[:, i : i + k + 1] at [:, i, k], or -1."""
        w, n = chars.shape
        top = min(self.m.longest, n)
        power = np.full(n, _BASE, _U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(n, _INV, _U)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        acc = np.zeros((w, n + 1), _U)
        np.cumsum((chars.astype(_U) + _U(1)) * power, axis=1, out=acc[:, 1:])
        out = np.full((w, n, top), -1, np.int32)
        for k in range(1, top + 1):
            h = _finish((acc[:, k:] - acc[:, : n + 1 - k]) * inverse[: n + 1 - k], k)
            at = np.minimum(np.searchsorted(self.m.keys, h), len(self.m.keys) - 1)
            out[:, : n + 1 - k, k - 1] = np.where(self.m.keys[at] == h, self.m.key_ids[at], -1)
        return out

    def merge(self, chars: np.ndarray) -> list[np.ndarray]:
        """Starts of the pieces that BPE merging of each row ends with."""
        w, n = chars.shape
        ids = self.spans(chars)
        score = np.where(ids >= 0, self.m.scores[ids], -np.inf)
        top = score.shape[2]
        starts = np.tile(np.arange(n + 1), (w, 1))  # padded with n
        cols = np.arange(n + 1)
        live = np.arange(w)
        while len(live) and starts.shape[1] > 2:
            s = starts[live]
            left, size = s[:, :-2], s[:, 2:] - s[:, :-2]
            ok = (s[:, 1:-1] < n) & (size <= top)
            gain = np.where(ok, score[live[:, None], np.minimum(left, n - 1), np.clip(size, 1, top) - 1], -np.inf)
            best = gain.argmax(axis=1)
            more = gain[np.arange(len(live)), best] > -np.inf
            live, best, s = live[more], best[more], s[more]
            moved = np.concatenate([s[:, 1:], np.full((len(live), 1), n)], axis=1)
            starts[live] = np.where(cols[None, :] > best[:, None], moved, s)
        return [r[: int(np.searchsorted(r, n))] for r in starts]

    def _admit(self, keys: np.ndarray) -> np.ndarray:
        """Is each (piece before) * base + piece admissible?"""
        out = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            out = self.pair_ok[at]
            left = np.flatnonzero(self.pair_keys[at] != keys)
        else:
            left = np.arange(len(keys))
        if len(left):
            asked = keys[left].tolist()
            new = [k for k in dict.fromkeys(asked) if k not in self.latest]
            if new:
                self._judge(new)
            out[left] = [self.latest[k] for k in asked]
            if len(self.latest) > 20_000:
                more = np.fromiter(self.latest, np.int64, len(self.latest))
                every = np.concatenate([self.pair_keys, more])
                order = np.argsort(every)
                self.pair_keys, self.pair_ok = every[order], np.concatenate([self.pair_ok, np.fromiter(self.latest.values(), bool, len(more))])[order]
                self.latest = {}
        return out

    def _judge(self, keys: list[int]) -> None:
        """Merge the text of each pair and see whether it ends as the pair."""
        by: dict[int, list[tuple[int, int, str]]] = {}
        for k in keys:
            u, t = divmod(k, self.none + 1)
            head = "" if u == self.none else self.m.pieces[u]
            text = head + self.m.pieces[t]
            by.setdefault(len(text), []).append((k, len(head), text))
        for group in by.values():
            chars = np.array([[ord(c) for c in t] for _, _, t in group], np.uint32)
            for (k, cut, _), starts in zip(group, self.merge(chars)):
                self.latest[k] = starts.tolist() == ([0, cut] if cut else [0])

    def cuts(self, chars: np.ndarray) -> np.ndarray:
        """Inner positions of a chunk that no piece crosses."""
        n, top = len(chars), self.m.longest
        change = np.zeros(n + 1, np.int64)
        for lo in range(0, n, _WINDOW):
            ids = self.spans(chars[None, lo : lo + _WINDOW + top - 1])[0, :_WINDOW]
            at, k = np.nonzero(ids[:, 1:] >= 0)  # pieces of k + 2 characters
            np.add.at(change, lo + at + 1, 1)
            np.add.at(change, lo + at + k + 2, -1)
        return np.flatnonzero(np.cumsum(change)[1:n] == 0) + 1

    def encode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (last first, padded with -1) of equal-length rows, and their start positions."""
        w, n = chars.shape
        top = min(self.m.longest, n)
        kind = np.float64 if self.m.bpe else np.float32  # the library adds in single precision too
        best = np.full((w, n + 1), -np.inf, kind)
        best[:, 0] = 0.0
        score = self.m.scores.astype(np.float32)
        last = np.full((w, n + 1), self.none, np.int32)  # piece that ends here
        back = np.zeros((w, n + 1), np.int32)
        floor = np.float32(self.m.scores[self.m.kinds == _NORMAL].min() - 10.0)
        lo = upto = 0
        for e in range(1, n + 1):
            if e > upto:
                lo, upto = max(0, e - top), min(n, e - 1 + max(_WINDOW // w, top))
                ids = self.spans(chars[:, lo:upto])
            k = np.arange(min(top, e), 0, -1)  # of equal scores the longest last piece wins
            cand = ids[:, e - k - lo, k - 1].astype(np.int64)  # piece over [e - k, e)
            reach = best[:, e - k]
            value = np.full(cand.shape, -np.inf, kind)
            r, c = np.nonzero((cand >= 0) & (reach > -np.inf))
            if self.m.bpe:
                ok = self._admit(last[r, e - k[c]].astype(np.int64) * (self.none + 1) + cand[r, c])
                value[r[ok], c[ok]] = reach[r[ok], c[ok]] + 1.0
            else:
                value[r, c] = reach[r, c] + score[cand[r, c]]
            lost = cand[:, -1] < 0  # a character that is no piece
            value[lost, -1] = reach[lost, -1] + (1.0 if self.m.bpe else floor)
            pick = value.argmax(axis=1)
            rows = np.arange(w)
            best[:, e] = value[rows, pick]
            back[:, e] = e - k[pick]
            last[:, e] = np.where(cand[rows, pick] < 0, self.none, cand[rows, pick])
        out, at, pos = [], [], np.full(w, n)
        rows = np.arange(w)
        while (pos > 0).any():
            out.append(np.where(pos > 0, last[rows, pos], -1))
            pos = np.where(pos > 0, back[rows, pos], 0)
            at.append(pos)
        return np.stack(out, axis=1), np.stack(at, axis=1)


class PieceEncoder(ChunkTable):
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.m = Model(f.read())
        self.lattice = Lattice(self.m)
        self.barrier = np.isin(np.arange(256), self.m.barriers)
        self._clear()

    def _buffer(self, col):
        data, off = text_buffer(col)
        mark = SPACE.encode()
        if mark in data:  # stands for a space
            texts = [data[i:j].replace(mark, b" ") for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            data, off = b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not self.m.prefix:
            return data, off
        some = np.flatnonzero(np.diff(off))
        raw = np.insert(np.frombuffer(data, np.uint8), off[some], 32)
        grown = np.zeros(len(off), np.int64)
        grown[some + 1] = 1
        return raw.tobytes(), off + np.cumsum(grown)

    def _cut(self, raw, off):
        head = np.zeros(len(raw) + 1, bool)
        space, wall = raw == 32, self.barrier[raw]
        head[1:-1] = (space[1:] & ~space[:-1]) | wall[1:] | wall[:-1]
        head[off] = True
        head[-1] = False
        start = np.flatnonzero(head)
        return start, np.diff(np.searchsorted(start, off))

    def _bytes_of(self, char: int) -> list[int]:
        if not self.m.byte_ids:
            return [self.m.unk]
        return [self.m.byte_ids[b] for b in chr(char).encode()]

    def _learn(self, data, hasher, start, end, h, check):
        texts = [data[i:j].decode().replace(" ", SPACE) for i, j in zip(start.tolist(), end.tolist())]
        long = [i for i, t in enumerate(texts) if len(t) > _LONG]
        for i in long:
            parts = self._parts(texts[i])
            found = dict.fromkeys(parts)
            for group, ids, sizes in self._encoded(list(found)):
                for t, own in zip(group, np.split(ids, np.cumsum(sizes)[:-1])):
                    found[t] = own
            ids = np.concatenate([found[t] for t in parts])
            self._add(h[i : i + 1], check[i : i + 1], ids, np.array([len(ids)]))
        short = [i for i, t in enumerate(texts) if len(t) <= _LONG]
        where: dict[str, int] = {texts[i]: i for i in short}
        for group, ids, sizes in self._encoded([texts[i] for i in short]):
            own = np.array([where[t] for t in group])
            self._add(h[own], check[own], ids, sizes)

    def _parts(self, text: str) -> list[str]:
        cuts = [0, *self.lattice.cuts(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _encoded(self, texts: list[str]):
        """(texts, their ids end to end, ids of each) of groups of equal length."""
        by: dict[int, list[str]] = {}
        for t in texts:
            by.setdefault(len(t), []).append(t)
        none = self.lattice.none
        for n, own in by.items():
            per = max(1, _CELLS // max(n, 1))
            for lo in range(0, len(own), per):
                group = own[lo : lo + per]
                chars = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(len(group), n)
                back, at = self.lattice.encode(chars)
                back, at = back[:, ::-1], at[:, ::-1]
                odd = (back == none).any(axis=1)
                keep = (back >= 0) & ~odd[:, None]
                if not odd.all():
                    yield [t for t, o in zip(group, odd.tolist()) if not o], back[keep].astype(np.uint32), keep[~odd].sum(axis=1)
                for r in np.flatnonzero(odd).tolist():  # with unknown characters
                    ids = [x for p, s in zip(back[r].tolist(), at[r].tolist()) if p >= 0 for x in (self._bytes_of(int(chars[r, s])) if p == none else (p,))]
                    yield [group[r]], np.array(ids, np.uint32), np.array([len(ids)])


class PieceDecoder:
    """ids -> text: the pieces' bytes end to end, without the leading space that encoding adds."""

    def __init__(self, model: Model):
        blobs = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds.tolist())]
        self.size = np.array([len(b) for b in blobs], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(blobs), np.uint8)
        self.prefix = model.prefix

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.first[ids] - (ends - size), size)
        where += np.arange(len(where))
        data = self.body[where].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [data[i:j] for i, j in zip(cuts, cuts[1:])]
        return [t[1:] if t[:1] == b" " else t for t in texts] if self.prefix else texts


_held: dict[str, tuple[PieceEncoder, PieceDecoder]] = {}


def codec(path: str) -> tuple[PieceEncoder, PieceDecoder]:
    if path not in _held:
        enc = PieceEncoder(path)
        _held[path] = enc, PieceDecoder(enc.m)
    return _held[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array of int) of every row."""

    def run(batches):
        enc, _ = codec(model)
        for whole in batches:
            for b in slices(whole, 1):
                ids, n = enc.encode_column(b.column(1))
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows of (doc_id, ids); null ids give null."""

    def run(batches):
        _, dec = codec(model)
        for whole in batches:
            for b in slices(whole, 1):
                rows = [np.array(x or [], np.int64) for x in b.column(1).to_pylist()]
                texts = dec(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows]))
                shown = [None if x is None else t.decode("utf-8", "replace") for x, t in zip(b.column(1).to_pylist(), texts)]
                yield pa.record_batch([b.column(0), pa.array(shown, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, same: encoded, decoded and compared in one pass."""
    mark = SPACE.encode()

    def run(batches):
        enc, dec = codec(model)
        for whole in batches:
            for b in slices(whole, 1):
                ids, n = enc.encode_column(b.column(1))
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
                texts = dec(ids, n)
                data, off = text_buffer(b.column(1))
                given = [data[i:j].replace(mark, b" ") for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.record_batch(
                    [
                        b.column(0),
                        pa.array(n),
                        pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cuts, cuts[1:])], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pa.array([t == g for t, g in zip(texts, given)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean")
