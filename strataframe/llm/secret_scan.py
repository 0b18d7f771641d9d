"""Secret scanning with multipart credential linking.

Strong spans (assigned secrets, access identifiers, long hex strings) are
always reported. Weak candidates (short assigned secrets, bearer values, user
or client identifiers, endpoints) are interval-joined with the other parts
inside a scope of ``window`` code points that does not cross a blank line, and
reported only when a complementary part is there that does not overlap them:
an identifier needs a secret, a secret needs an identifier or an endpoint, an
endpoint needs a secret that is named as one (a bare hex string, which may be
any digest, is not). The interval join is a sorted search over all parts of a batch, so a
document with many parts costs n log n and no pairs are emitted.

Defined cases: null or empty text has no spans; a null doc_id passes through;
repeated rows are scanned each on their own; other columns are ignored; an
empty table gives an empty result. Offsets count code points, end exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)  # maximal runs of 16 or more: the same spans as longer-than-15 runs of [0-9a-f]+
ASSIGN_MIN, ACCESS_MIN, WEAK_MIN = 12, 18, 6
_IDENT = re.compile(r"""(?i:user(?:_?name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII)
_BEARER = re.compile(r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{8,})", re.ASCII)
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\s"'<>]+""", re.ASCII)
_BREAK = re.compile(r"\n[ \t\r]*\n")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDENT_HINTS = ("user", "login", "client", "account", "access")

#: Kinds in report order; the class of each: identifier (0), secret (1), endpoint (2) or bare hex (3).
KINDS = ("assign", "access", "hex", "weak_assign", "bearer", "ident", "endpoint")
BASE = 3
_CLASS = np.array([1, 0, 3, 1, 1, 0, 2])
#: What the weak parts of a class need nearby.
_NEEDS = ((0, (1, 3)), (1, (0, 2)), (2, (1,)))
WINDOW = 300


def _parts(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all candidates of one text."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in _ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= WEAK_MIN:
                out.append((m.start(), m.end(), 0 if n >= ASSIGN_MIN else 3))
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    if "bearer" in low:
        out += [(m.start(), m.end(), 4) for m in _BEARER.finditer(text)]
    if any(h in low for h in _IDENT_HINTS):
        out += [(m.start(), m.end(), 5) for m in _IDENT.finditer(text)]
    if "://" in text:
        out += [(m.start(), m.end(), 6) for m in _ENDPOINT.finditer(text)]
    return out


def _near(s: np.ndarray, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each part [s, e): does any other end at most ``window`` before it or start at most ``window`` after it?"""
    starts, ends = np.sort(starts), np.sort(ends)
    before = np.searchsorted(ends, s, "right") > np.searchsorted(ends, s - window, "left")
    after = np.searchsorted(starts, e + window, "right") > np.searchsorted(starts, e, "left")
    return before | after


def link(start: np.ndarray, end: np.ndarray, kind: np.ndarray, scope: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which parts are reported: strong ones, and weak ones with a complement in scope.

    ``scope`` numbers the blank-line blocks (of all documents of a batch); the
    coordinates of different scopes are moved apart, so one interval join
    serves the whole batch.
    """
    keep = kind < BASE
    if not len(start) or keep.all():
        return keep
    base = np.zeros(int(scope.max()) + 2, np.int64)
    np.maximum.at(base, scope + 1, end + 2 * window + 2)
    shift = np.cumsum(base)[scope]
    s, e, cls = start + shift, end + shift, _CLASS[kind]
    weak = ~keep
    for mine, needs in _NEEDS:
        ask = np.flatnonzero(weak & (cls == mine))
        other = np.flatnonzero(np.isin(cls, needs))
        keep[ask] = _near(s[ask], e[ask], s[other], e[other], window)
    return keep


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("spans", SPANS)])


def _scan(window: int):
    def run(batches):
        for b in batches:
            rows, n = [], b.num_rows
            blocks = 0
            for row, text in enumerate(b.column(1).to_pylist()):
                found = _parts(text) if text else None
                if found:
                    weak = any(k >= BASE for _, _, k in found)
                    edges = [m.end() for m in _BREAK.finditer(text)] if weak else []
                    at = np.searchsorted(edges, [f[0] for f in found], "right") if edges else [0] * len(found)
                    rows += [(row, s, e, k, blocks + int(x)) for (s, e, k), x in zip(found, at)]
                    blocks += len(edges) + 1
            a = np.array(rows, np.int64).reshape(-1, 5)
            a = a[link(a[:, 1], a[:, 2], a[:, 3], a[:, 4], window)]
            a = a[np.lexsort((a[:, 3], a[:, 1], a[:, 0]))]
            counts = np.bincount(a[:, 0], minlength=n)
            items = pa.StructArray.from_arrays(
                [pa.array(np.array(KINDS, object)[a[:, 3]], pa.string()), pa.array(a[:, 1]), pa.array(a[:, 2]), pa.array(a[:, 3] < BASE)], fields=list(SPANS.value_type)
            )
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)
            yield pa.record_batch([b.column(0), spans.cast(SPANS)], schema=_OUT)

    return run


def scan_secrets(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and its reported spans (kind, start, end, strong) by start, then kind."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(window), "doc_id long, spans array<struct<kind:string,start:long,end:long,strong:boolean>>")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; other columns unchanged."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = []
            for text in b.column(b.schema.names.index("text")).to_pylist():
                found = _parts(text) if text else []
                if found:
                    edges = [m.end() for m in _BREAK.finditer(text)]
                    a = np.array([(s, e, k, np.searchsorted(edges, s, "right")) for s, e, k in found], np.int64)
                    kept = sorted((int(s), int(e)) for s, e in a[link(*a.T, window=WINDOW)][:, :2])
                    out, at = [], 0
                    for s, e in kept:
                        if e <= at:
                            continue
                        out += [text[at:s], mark] if s >= at else []
                        at = e
                    text = "".join(out) + text[at:]
                texts.append(text)
            cols = list(b.columns)
            cols[b.schema.names.index("text")] = pa.array(texts, pa.string())
            yield pa.record_batch(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The counted and hashed columns of ``op4`` from ``scan_secrets``."""
    as_text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda s: s["strong"])), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )
