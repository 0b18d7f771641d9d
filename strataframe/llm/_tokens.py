"""Encoding with a tokenizers file, remembering the chunks met before.

Both kinds of file used here (byte-level pre-tokens, with or without a word
end) split a text into pre-tokens before merging, and no pre-token reaches
from a character that is no white space into one that is. So a text may be cut
before every run of white space (and after a run that is one line feed), and
each distinct chunk needs the library once. Chunks are found and hashed for a
whole batch by numpy and looked up in an open-addressing table; their length
and their first and last bytes must agree too. An unseen chunk that begins with Latin letters
is cut once more, after them, since a pre-token of letters ends there; its
letters go straight to the file's merge model.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from strataframe.llm._common import text_buffer

_LETTER = np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
#: Bytes that may follow a word cut off a chunk: printable ASCII that is no letter.
_AFTER = np.zeros(256, bool)
_AFTER[0x21:0x7F] = ~_LETTER[0x21:0x7F]
#: Chunks remembered by a worker; beyond them those met in one batch only go.
CACHE = 1_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_held: dict[tuple, ChunkEncoder] = {}
_powers: list[np.ndarray] = []


def encoder(path: str, end_id: int, cache: int = CACHE) -> ChunkEncoder:
    """This worker's encoder for a file; it outlives tasks where workers do."""
    if (path, end_id) not in _held:
        _held[path, end_id] = ChunkEncoder(path, end_id)
        _held[path, end_id].cache = cache
    return _held[path, end_id]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), b, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


class _Hasher:
    """A hash and a check of any byte ranges of a buffer, 64 bits each.

    The hash comes from running sums made once. The check is made of the
    length and the first and last eight bytes themselves: of a range of up to
    eight bytes, which most are, it is the bytes.
    """

    def __init__(self, raw: np.ndarray):
        wide = raw.astype(_U)
        wide += _U(1)
        power, self.inverse = _powers_to(len(raw) + 1)
        wide *= power[: len(raw)]
        self.sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(wide, out=self.sums[1:])
        padded = np.zeros(len(raw) + 16, np.uint8)
        padded[8:-8] = raw
        # the eight bytes before each place of the buffer, as one number
        self.eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (end - start).astype(_U)
        h = _mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + size)
        spare = np.maximum(_U(8) - np.minimum(size, _U(8)), _U(0)) << _U(3)
        last = self.eight[end] >> np.minimum(spare, _U(63))
        long = np.flatnonzero(size > 8)
        last[long] ^= self.eight[start[long] + 8] * _U(0xD6E8FEB86659FD93)
        return h, last + (size << _U(56))


def _white(raw: np.ndarray) -> np.ndarray:
    """Bytes that belong to a white-space character."""
    ws = (raw == 32) | ((raw >= 9) & (raw <= 13))
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead < len(raw) - 1]
    if len(lead):
        a, b = raw[lead], raw[lead + 1]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        lead = lead[lead < len(raw) - 2]
        a, b, c = raw[lead], raw[lead + 1], raw[lead + 2]
        three = lead[
            ((a == 0xE1) & (b == 0x9A) & (c == 0x80))
            | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
            | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        ]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                ws[at + k] = True
    return ws


def cut(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all chunks of a text buffer, and how many each text has."""
    n = len(raw)
    ws = _white(raw)
    head = np.zeros(n + 1, bool)
    head[1:n] = ws[1:] & ~ws[:-1]
    head[off] = True  # texts never share a chunk; the last mark is the buffer's end
    begins = head[:-1] | np.concatenate([[True], ~ws[:-1]])
    lone = np.flatnonzero((raw == 10) & begins)  # a run that begins with a line feed
    lone = lone[lone + 1 < n]
    lone = lone[~ws[lone + 1] & ~head[lone + 1]]
    head[lone + 1] = True
    head[n] = False
    start = np.flatnonzero(head)
    return start, np.diff(np.searchsorted(start, off))


def _byte_letters() -> dict[int, str]:
    """Byte-level files write every byte as one printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkTable:
    """Ids of chunks, found by hash. Subclasses say how chunks are learnt and cut."""

    end_ids: tuple[int, ...] = ()
    cache = CACHE

    def _learn(self, data: bytes, hasher: _Hasher, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Add the chunks data[start : end], which differ from each other."""
        raise NotImplementedError

    def _cut(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cut(raw, off)

    def _buffer(self, col: pa.Array) -> tuple[bytes, np.ndarray]:
        return text_buffer(col)

    def _clear(self) -> None:
        """Entry 0 is what ends a text; entries are found by slots of their first hash."""
        self.size = 1
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = len(self.end_ids)
        self.ids[: self.used] = self.end_ids
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.count[0] = self.used
        self.key, self.check = np.zeros(1 << 14, _U), np.zeros(1 << 14, _U)
        self.again = np.zeros(1 << 14, bool)
        self.slots = np.zeros(1 << 16, np.int32)

    def _forget(self) -> None:
        """Keep the chunks found again after they were learnt, if they are few enough."""
        kept = np.flatnonzero(self.again[: self.size])
        kept = kept[kept > 0]
        if len(kept) > self.cache * 3 // 4:
            return self._clear()
        old = self.key[kept], self.check[kept], self._gather(kept), self.count[kept].astype(np.int64)
        self._clear()
        self._add(*old)

    def _find(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each chunk, or -1."""
        mask = _U(len(self.slots) - 1)
        slot = (h & mask).view(np.int64)
        out = self.slots.take(slot)
        good = (self.key.take(out) == h) & (self.check.take(out) == check) & (out > 0)
        left = np.flatnonzero(~good & (out > 0))
        out[out == 0] = -1
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            e = self.slots.take(slot[left])
            hit = (self.key.take(e) == h[left]) & (self.check.take(e) == check[left])
            done = hit | (e == 0)
            out[left[done]] = np.where(e[done] == 0, -1, e[done])
            left = left[~done]
        return out

    def _place(self, entries: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (self.key[entries] & _U(mask)).view(np.int64)
        while len(entries):
            free = np.flatnonzero(self.slots[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slots[slot[won]] = entries[won]
            keep = np.ones(len(entries), bool)
            keep[won] = False
            entries, slot = entries[keep], (slot[keep] + 1) & mask

    def _gather(self, at: np.ndarray) -> np.ndarray:
        count = self.count[at]
        ends = np.cumsum(count, dtype=np.int64)
        where = np.repeat(self.first[at] - (ends - count), count)
        where += np.arange(len(where))
        return self.ids[where]

    def _add(self, h: np.ndarray, check: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        at, size, end = self.size, self.size + len(h), self.used + len(flat)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(end - len(self.ids), len(self.ids) // 2), np.uint32)])
        if size > len(self.first):
            more = max(size - len(self.first), len(self.first) // 2)
            for name in ("first", "count", "key", "check", "again"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(more, old.dtype)]))
        self.ids[self.used : end] = flat
        self.first[at:size] = self.used + np.cumsum(n) - n
        self.count[at:size], self.key[at:size], self.check[at:size] = n, h, check
        self.size, self.used = size, end
        if 2 * size > len(self.slots):
            self.slots = np.zeros(1 << (4 * size).bit_length(), np.int32)
            self._place(np.arange(1, size, dtype=np.int32))
        else:
            self._place(np.arange(at, size, dtype=np.int32))

    def encode_column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end ids, and how many each text has."""
        if self.size > self.cache:
            self._forget()
        data, off = self._buffer(col)
        docs = len(off) - 1
        raw = np.frombuffer(data, np.uint8)
        start, n = self._cut(raw, off) if len(raw) else (np.zeros(0, np.int64), np.zeros(docs, np.int64))
        end = np.append(start[1:], len(raw))
        hasher = _Hasher(raw)
        h, check = hasher(start, end)
        at = self._find(h, check)
        self.again[at[at > 0]] = True
        miss = np.flatnonzero(at < 0)
        if len(miss):
            _, one = np.unique(h[miss], return_index=True)
            new = miss[one]
            self._learn(data, hasher, start[new], end[new], h[new], check[new])
            at[miss] = self._find(h[miss], check[miss])
        all_at = np.zeros(len(at) + docs, np.int32)  # entry 0 after each text's chunks
        all_at[np.arange(len(at)) + np.repeat(np.arange(docs), n)] = at
        count = self.count[all_at]
        total = np.diff(np.cumsum(count, dtype=np.int64)[np.cumsum(n + 1) - 1], prepend=0)
        return self._gather(all_at), total


class ChunkEncoder(ChunkTable):
    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.end_ids = (end_id,)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["normalizer"] or {"normalizers": []}).get("normalizers", [])
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.words = None
        if spec["model"]["type"] == "BPE" and "ByteLevel" in json.dumps(spec["pre_tokenizer"]) and all(x["type"] in ("NFC", "Replace", "Lowercase") for x in steps):
            spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}}
            self.words = Tokenizer.from_str(json.dumps(spec))
            self.letters = np.array([ord(c) for _, c in sorted(_byte_letters().items())], np.uint16)
        self._clear()

    def _learn_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        """Chunks of letters, each one pre-token: only the merges are left to do."""
        for lo in range(0, len(start), 4000):
            s, e = start[lo : lo + 4000], end[lo : lo + 4000]
            if self.lower:
                s = s + (raw[s] == 32)
            size = e - s + 1  # with a line feed between
            ends = np.cumsum(size)
            at = np.repeat(s - (ends - size), size) + np.arange(int(ends[-1]))
            text = raw[np.minimum(at, len(raw) - 1)]
            if self.lower:
                big = ((text >= 65) & (text <= 90)) | ((text >= 0x80) & (text <= 0x9E) & (np.concatenate([[0], text[:-1]]) == 0xC3))
                text = text + (big.view(np.uint8) << 5)
            shown = self.letters[text]
            shown[ends - 1] = 10
            got = self.words.encode(shown[:-1].tobytes().decode("utf-16-le"), add_special_tokens=False)
            self._add(h[lo : lo + 4000], check[lo : lo + 4000], np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids), minlength=len(s)))

    def _learn_whole(self, data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray, check: np.ndarray) -> None:
        got = [e.ids for e in self.lib.encode_batch([data[i:j].decode() for i, j in zip(start.tolist(), end.tolist())], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self._add(h, check, np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n)

    def _unknown(self, hasher: _Hasher, start: np.ndarray, end: np.ndarray):
        """The distinct ranges that are not entries yet, with their hashes; and the hashes of all."""
        h, check = hasher(start, end)
        _, one = np.unique(h, return_index=True)
        new = one[self._find(h[one], check[one]) < 0]
        return (start[new], end[new], h[new], check[new]), h, check

    def _learn(self, data, hasher, start, end, h, check) -> None:
        if self.words is None:
            return self._learn_whole(data, start, end, h, check)
        raw = np.frombuffer(data, np.uint8)
        size = end - start
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
        body = raw[at]
        letter = _LETTER[body]
        wide = np.flatnonzero(body[:-1] == 0xC3)
        wide = wide[(body[wide + 1] >= 0x80) & (body[wide + 1] <= 0xBF) & (body[wide + 1] != 0x97) & (body[wide + 1] != 0xB7)]
        letter[wide] = letter[wide + 1] = True
        heads = ends - size
        spaced = (body[heads] == 32).astype(np.int64)
        letter[heads[spaced > 0]] = True
        stop = start + np.minimum.reduceat(np.where(letter, len(body), np.arange(len(body))), heads).clip(max=ends) - heads
        worded = stop - start > spaced
        simple = worded & (stop == end)
        joint = worded & ~simple & _AFTER[raw[np.minimum(stop, len(raw) - 1)]]
        alone = ~(simple | joint)
        self._learn_words(raw, start[simple], end[simple], h[simple], check[simple])
        self._learn_whole(data, start[alone], end[alone], h[alone], check[alone])
        if joint.any():
            start, stop, end, h, check = (x[joint] for x in (start, stop, end, h, check))
            words, word_h, word_check = self._unknown(hasher, start, stop)
            self._learn_words(raw, *words)
            rests, rest_h, rest_check = self._unknown(hasher, stop, end)
            self._learn_whole(data, *rests)
            todo = np.flatnonzero(self._find(h, check) < 0)  # a word and its rest may be a rest themselves
            pairs = np.stack([self._find(word_h[todo], word_check[todo]), self._find(rest_h[todo], rest_check[todo])], axis=1)
            self._add(h[todo], check[todo], self._gather(pairs.reshape(-1)), self.count[pairs].sum(axis=1))
