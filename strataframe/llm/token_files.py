"""Token-ID files with an adaptive context-mixing range coder.

A file image holds up to ``FILE_TOKENS`` ids of consecutive documents:

    magic "SFT2" | header length u32 | header (zlib): u32 counts (docs, ids,
    symbols, block ids), doc_ids i64 as differences, a byte for each that is
    null, ids of each document u32, symbols u32, their frequencies u32, payload
    words and CRC-32 of each block | payload words u32, block after block
    (all little endian)

Blocks of ``BLOCK`` ids are coded independently: everything that adapts starts
afresh in each, and each has a checksum of its ids. An id is coded in one
range-coder step from a mix of three predictions. The order-2 and order-1
contexts of the block each predict one id with a confidence; confidence and
recent success of the order set how much of the range its prediction gets. The
rest belongs to order 0: the ids of the block so far, counted anew at the
steps of ``_RECOUNT``, have half of it, and the frequencies of the file the
other half, for ids that are new to the block. All blocks of
an image advance together as numpy lanes, so the work a Python step costs is
shared by thousands of ids.

Defined cases: null or empty text is the end id alone; null doc_ids come
first; rows that repeat a doc_id are kept each, in an order that the files
fix; an empty table gives no files and an empty result; other columns are
ignored; a damaged block raises ``ValueError`` on reading.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm._common import release_memory, slices, stage_table
from strataframe.llm._tokens import encoder

MAGIC = b"SFT2"
BLOCK = 1024
FILE_TOKENS = 3_000_000
_U = np.uint64
_TOP = _U(1 << 32)

# Share (of 256) that a prediction gets by its confidence, order 1 and order 2,
# for four levels of the order's recent success.
_LEVELS = np.array([[0.4], [0.7], [0.95], [1.15]])
_SHARE1 = (_LEVELS * [0, 10, 22, 36, 50, 64, 78, 92]).astype(np.uint64).reshape(-1)
_SHARE2 = (_LEVELS * [0, 20, 44, 64, 84, 100, 114, 126]).astype(np.uint64).reshape(-1)
# By confidence after a miss (first 8) and a hit (last 8): the next one.
_NEXT = (np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7]) << 24).astype(np.int32)
_S1, _S2 = 8, 9  # log2 of the contexts a lane remembers
_H1, _H2, _R1, _R2 = (np.uint32(x) for x in (40503, 60493, 6, 5))
_EVERY = 8  # steps between two updates of the success levels
#: Steps (powers of two) after which order 0 counts the block's ids anew; the counts then get half of its range.
_RECOUNT = (256,)


class _Order:
    """What one context order of every lane predicts."""

    def __init__(self, lanes: int, bits: int, share: np.ndarray):
        self.table, self.base, self.mask = np.zeros(lanes << bits, np.int32), np.arange(lanes, dtype=np.uint32) << np.uint32(bits), np.uint32((1 << bits) - 1)
        self.share, self.rate, self.level = share, np.full(lanes, 128, np.int32), np.full(lanes, 16, np.int32)

    def look(self, context: np.ndarray) -> np.ndarray:
        context &= self.mask
        context += self.base
        self.at = at = context.astype(np.intp)
        e = self.table.take(at)
        self.guess = e & 0xFFFFFF
        self.conf = e >> 24
        return self.share.take(self.conf + self.level)

    def learn(self, s: np.ndarray, hit: np.ndarray, adapt: bool) -> None:
        # a sure prediction outlives a miss; after a hit it is what came
        kept = np.where(self.conf > 2, self.guess, s)
        kept |= _NEXT.take(self.conf + (hit.view(np.int8) << 3))
        self.table[self.at] = kept
        if adapt:
            self.rate += ((hit * np.int32(255)) - self.rate >> 3) * (self.conf > 0)
            self.level = self.rate >> 6 << 3


class _Mixer:
    """The adaptive predictions of all lanes; the same on both sides."""

    def __init__(self, lanes: int):
        self.one, self.two = _Order(lanes, _S1, _SHARE1), _Order(lanes, _S2, _SHARE2)
        self.last = self.before = np.zeros(lanes, np.uint32)
        self.step = 0

    def predict(self):
        """Shares of the range for the ids that orders 2 and 1 predict."""
        a = self.last * _H1  # 32 bits, and no carry beyond them
        f2 = self.two.look((a ^ self.before * _H2) >> _R2)
        f1 = self.one.look(a >> _R1)
        f1 *= (self.one.guess != self.two.guess) | (f2 == 0)
        return f2, f1

    def update(self, s: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """The ids that came (32 bits), and where the orders had guessed them."""
        self.step += 1
        adapt = self.step % _EVERY == 0
        self.one.learn(s, hit1, adapt)
        self.two.learn(s, hit2, adapt)
        self.before, self.last = self.last, s.view(np.uint32)


def _frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies of at least 1 that add up to a power of two."""
    bits = 16 if len(counts) <= 1 << 15 else 20
    total = 1 << bits
    f = 1 + counts * (total - len(counts)) // counts.sum()
    f[f.argmax()] += total - f.sum()
    return f, bits


def _segments(n: int) -> list[tuple[int, int]]:
    """First step and end of the stretches with the same order-0 counts: those of the ids before the first step."""
    marks = [0, *[t for t in _RECOUNT if t < n], n]
    return list(zip(marks, marks[1:]))


def _sorted_runs(past: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of each row sorted, and for every place where its run of equal ids begins and how long it is."""
    t = past.shape[1]
    ids = np.sort(past.astype(np.uint16), axis=1, kind="stable") if symbols <= 1 << 16 else np.sort(past, axis=1)
    first = np.ones(ids.shape, bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=first[:, 1:])
    heads = np.flatnonzero(first)
    size = np.diff(np.append(heads, ids.size))
    return ids, np.repeat(heads & t - 1, size).reshape(ids.shape), np.repeat(size, size).reshape(ids.shape)


def _order0(blocks: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every id in the order-0 range of 2^(bits + 1), a row for each step."""
    lanes, n = blocks.shape
    start, size = np.zeros((n, lanes), np.uint32), np.zeros((n, lanes), np.uint32)
    freq = freq.astype(np.uint32)
    cum = np.cumsum(freq, dtype=np.uint32) - freq
    step = max(1, (1 << 18) // len(freq))
    seen = np.zeros(step * len(freq), np.uint32)  # by lane and id: where its run begins, and its length
    for lo in range(0, lanes, step):
        part = blocks[lo : lo + step]
        row = (np.arange(len(part)) * len(freq))[:, None]
        for t, end in _segments(n):
            s = part[:, t:end]
            a, z = cum.take(s), freq.take(s)
            if t:
                shift = bits - (t.bit_length() - 1)
                past, begin, count = _sorted_runs(part[:, :t], len(freq))
                own = row + past
                seen[own] = begin << 16 | count
                k = seen.take(row + s)
                old = k > 0
                a += np.uint32(1 << bits)
                np.copyto(a, k >> 16 << shift, where=old)
                np.copyto(z, (k & 0xFFFF) << shift, where=old)
                seen[own] = 0
            else:
                a, z = a << 1, z << 1
            start[t:end, lo : lo + step], size[t:end, lo : lo + step] = a.T, z.T
    return start, size


def _code(blocks: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Code the rows of ``blocks`` as lanes: words of all lanes and their number in each."""
    lanes, n = blocks.shape
    start0, size0 = _order0(blocks, freq, bits)
    narrow = np.ascontiguousarray(blocks.T)
    mix, pb, whole = _Mixer(lanes), _U(bits + 1), _U(bits + 9)
    low, rng = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
    out = np.zeros((lanes, n * (bits + 13) // 32 + 8), np.uint32)
    at = np.zeros(lanes, np.int64)
    for t in range(n):
        s = narrow[t]
        f2, f1 = mix.predict()
        used = f2 + f1
        f0 = _U(256) - used
        if t % 32 == 0:  # wide only for a while, so that they stay near
            wide_start, wide_size = start0[t : t + 32].astype(_U), size0[t : t + 32].astype(_U)
        start, size = wide_start[t % 32], wide_size[t % 32]
        start *= f0
        size *= f0
        hit1, hit2 = mix.one.guess == s, mix.two.guess == s
        used <<= pb
        start += used
        in1, in2 = hit1 & (f1 > 0), hit2 & (f2 > 0)
        np.copyto(start, f2 << pb, where=in1)
        np.copyto(size, f1 << pb, where=in1)
        np.copyto(start, _U(0), where=in2)
        np.copyto(size, f2 << pb, where=in2)
        r = rng >> whole
        start *= r
        low += start
        over = np.flatnonzero(low < start)
        rng = r * size
        if len(over):  # carry into the words already out
            at_word = at[over] - 1
            while len(over):
                out[over, at_word] += np.uint32(1)
                more = out[over, at_word] == 0
                over, at_word = over[more], at_word[more] - 1
        short = np.flatnonzero(rng < _TOP)
        if len(short):
            x = low[short]
            out[short, at[short]] = x >> _U(32)
            at[short] += 1
            low[short] = x << _U(32)
            rng[short] <<= _U(32)
        mix.update(s, hit2, hit1)
    rows = np.arange(lanes)
    out[rows, at] = low >> _U(32)
    out[rows, at + 1] = low & _U(0xFFFFFFFF)
    return out, at + 2


def _decode(words: np.ndarray, sizes: np.ndarray, n: int, freq: np.ndarray, bits: int) -> np.ndarray:
    lanes = len(sizes)
    freq64, cum64 = freq.astype(_U), (np.cumsum(freq) - freq).astype(_U)
    symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    inverse = np.ceil((1 << 37) / np.maximum(np.arange(257), 1)).astype(_U)  # exact under 2^29 / f0, and f0 is 6 at least
    mix, pb, whole = _Mixer(lanes), _U(bits + 1), _U(bits + 9)
    top = _U((1 << (bits + 9)) - 1)
    words = np.concatenate([words, np.zeros(4, np.uint32)]).astype(_U)
    at = np.cumsum(sizes) - sizes
    code = words[at] << _U(32) | words[at + 1]
    at = at + 2
    rng = np.full(lanes, 2**64 - 1, _U)
    steps = np.zeros((n, lanes), np.int32)
    for t0, end in _segments(n):
        if t0:
            shift, known = _U(bits - (t0.bit_length() - 1)), _U(1 << bits)
            ids, begin, count = (x.reshape(-1).astype(_U) for x in _sorted_runs(np.ascontiguousarray(steps[:t0].T), len(freq)))
            runs, row = ids << _U(32) | begin << _U(16) | count, np.arange(lanes) * t0
        for t in range(t0, end):
            f2, f1 = mix.predict()
            used = f2 + f1
            f0 = _U(256) - used
            r = rng >> whole
            v = np.minimum(code // r, top)
            z2, z1 = f2 << pb, used << pb
            in0 = v >= z1
            in2 = v < z2
            v0 = ((v - z1) * in0 * inverse.take(f0.view(np.int64))) >> _U(37)  # divided by f0
            if t0:
                s = symbol.take((v0 - known).view(np.int64), mode="clip")
                start, size = cum64.take(s), freq64.take(s)
                start += known
                old = np.flatnonzero(v0 < known)
                run = runs.take(row.take(old) + (v0.take(old) >> shift).view(np.int64))
                s[old], start[old], size[old] = run >> _U(32), (run >> _U(16) & _U(0xFFFF)) << shift, (run & _U(0xFFFF)) << shift
            else:
                s = symbol.take((v0 >> _U(1)).view(np.int64))
                start, size = cum64.take(s) << _U(1), freq64.take(s) << _U(1)
            start *= f0
            start += z1
            size *= f0
            in1 = ~(in0 | in2)
            np.copyto(s, mix.one.guess, where=in1)
            np.copyto(start, z2, where=in1)
            np.copyto(size, f1 << pb, where=in1)
            np.copyto(s, mix.two.guess, where=in2)
            np.copyto(start, _U(0), where=in2)
            np.copyto(size, z2, where=in2)
            code -= r * start
            rng = r * size
            short = np.flatnonzero(rng < _TOP)
            if len(short):
                w = at[short]
                code[short] = code[short] << _U(32) | words.take(w, mode="clip")
                at[short] = w + 1
                rng[short] <<= _U(32)
            steps[t] = s
            mix.update(steps[t], mix.two.guess == s, mix.one.guess == s)
    return steps


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in order, the place of each id among them, and how often each occurs."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    tally = np.bincount(ids)
    symbols = np.flatnonzero(tally)
    place = np.zeros(len(tally), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place.take(ids), tally[symbols]


def pack_image(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, nulls: np.ndarray | None = None) -> bytes:
    """The bytes of one file: documents' ids one after another. ``nulls`` marks doc_ids that are null."""
    symbols, dense, tally = _dense(ids)
    freq, bits = _frequencies(tally.astype(np.int64))
    lanes = -(-len(ids) // block)
    n = min(block, len(ids))
    padded = np.zeros(lanes * n, np.int32)
    padded[: len(ids)] = dense
    words, sizes = _code(padded.reshape(lanes, n), freq, bits)
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * i : 4 * (i + block)]) for i in range(0, len(ids), block)]
    u4 = lambda x: np.asarray(x).astype("<u4").tobytes()
    head = zlib.compress(b"".join([u4([len(doc_ids), len(ids), len(symbols), n]), np.diff(doc_ids, prepend=0).astype("<i8").tobytes(), (np.zeros(len(doc_ids), bool) if nulls is None else nulls).tobytes(), u4(counts), u4(symbols), u4(freq), u4(sizes), u4(crc)]), 6)
    body = words[np.arange(words.shape[1]) < sizes[:, None]].astype("<u4").tobytes()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, body])


def unpack_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, the ids, and which doc_ids are null. Raises ValueError where a checksum differs."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    end = 8 + int.from_bytes(image[4:8], "little")
    head = zlib.decompress(image[8:end])
    docs, total, n_symbols, n = np.frombuffer(head, "<u4", 4).astype(np.int64).tolist()
    lanes = -(-total // n)
    at = 16

    def take(dtype, k):
        nonlocal at
        x = np.frombuffer(head, dtype, k, at)
        at += x.nbytes
        return x.astype(np.int64)

    doc_ids, nulls, counts, symbols, freq, sizes, crc = np.cumsum(take("<i8", docs)), take("u1", docs).astype(bool), take("<u4", docs), take("<u4", n_symbols), take("<u4", n_symbols), take("<u4", lanes), take("<u4", lanes)
    words = np.frombuffer(image, "<u4", offset=end)
    steps = _decode(words, sizes, n, freq, int(freq.sum()).bit_length() - 1)
    ids = symbols.astype(np.uint32)[steps.T.reshape(-1)[:total]]
    raw = memoryview(ids.astype("<u4").tobytes())
    for k, want in enumerate(crc.tolist()):
        if zlib.crc32(raw[4 * k * n : 4 * (k + 1) * n]) != want:
            raise ValueError(f"block {k} is damaged")
    return doc_ids, counts, ids, nulls


def write_images(docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS, block: int = BLOCK) -> DataFrame:
    """Rows (part, seq, n_tokens, image): files in ascending doc_id order.

    Range partitioning by doc_id, then by a hash of the text, keeps the order
    across parts and splits a doc_id (or null) that very many rows have; a part
    is a sequence of files, so memory does not grow with its size.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def image():
            doc_ids, nulls, counts, ids = (np.concatenate(x) for x in zip(*held))
            return pa.record_batch([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack_image(doc_ids, counts, ids, block, nulls)], pa.binary())], names=["part", "seq", "n_tokens", "image"])

        for whole in batches:
            for b in slices(whole, 1):
                ids, n = enc.encode_column(b.column(1))
                held.append((b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False), n, ids))
                size += len(ids)
                if size >= file_tokens:
                    yield image()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield image()
        del held
        release_memory()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    return ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "part long, seq long, n_tokens long, image binary")


def read_images(images: DataFrame) -> DataFrame:
    """part, seq, doc_id, at (ids before it in its file), n_tokens, ids_crc32, from the files' bytes."""

    def run(batches):
        for b in batches:
            for part, seq, image in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                doc_ids, counts, ids, nulls = unpack_image(image)
                raw = memoryview(ids.astype("<u4").tobytes())
                end = np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((end - counts).tolist(), end.tolist())]
                n = len(doc_ids)
                yield pa.record_batch(
                    [pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(doc_ids, mask=nulls), pa.array(end - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )
        release_memory()

    return images.select("part", "seq", "image").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")


def file_starts(images: DataFrame) -> DataFrame:
    """part, seq, base: ids before each file. Only one row a part meets in one task."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = images.select("part", "seq", F.col("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("own_part"), before(Window.orderBy("part")).alias("part_base"))
    within = sizes.select("part", "seq", before(Window.partitionBy("part").orderBy("seq")).alias("file_base"))
    return within.join(parts, F.col("part") == F.col("own_part")).select("part", "seq", (F.col("part_base") + F.col("file_base")).alias("base"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    images = stage_table(write_images(docs, tokenizer, end_id), "token-files")
    back, starts = read_images(images), file_starts(images).withColumnsRenamed({"part": "s_part", "seq": "s_seq"})
    joined = back.join(starts, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq")))
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(images: DataFrame, folder: str) -> None:
    """Each image as a file of its own, part-seq.sft, in a folder that all machines share."""

    def run(rows):
        for r in rows:
            path = os.path.join(folder, f"{r['part']:06d}-{r['seq']:06d}.sft")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(bytes(r["image"]))
            os.replace(f"{path}.{os.getpid()}", path)

    os.makedirs(folder, exist_ok=True)
    images.foreachPartition(run)
