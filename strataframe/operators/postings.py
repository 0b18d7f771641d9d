"""A stored inverted index: postings by term in Parquet, appended batch by batch, searched with pruning.

A posting list is cut into blocks, one for each shard of documents, so it is
bounded whatever the term; a block keeps its largest term frequency and its
shortest document, which bound every score inside it under any mean length.
Queries read the blocks of their terms, never the texts: the blocks of a shard
meet in one task, and a query skips a shard whose bounds together stay under
its k-th best score so far.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.functions import text as X
from strataframe.operators.retrieval import B, EPSILON, K1, top_k

#: Documents of a shard.
SHARD_DOCS = 1024
#: Terms of queries that are asked in one pass: what is broadcast and what the driver holds at a time.
ASKED_TERMS = 50_000
#: Rounding that pruning never relies on.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """Postings (term, batch, shard, max_tf, min_dl, list), terms (term, batch, df) and lengths (dl, docs, batch)."""

    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame


#: The term of the list that holds all documents of a shard with their lengths; words hold no spaces.
ALL = " "


def _lists(batch: int):
    """Rows (shard, key, w) sorted by shard -> (term, batch, shard, max_tf, min_dl, list), a shard's lists at a time."""

    def shard(number: int, rows: pa.Table) -> pa.RecordBatch:
        rows = rows.append_column("dl", pc.list_value_length(rows.column("w"))).sort_by([("key", "ascending"), ("dl", "ascending")])
        w, keys, dl = (rows.column(c).combine_chunks() for c in ("w", "key", "dl"))
        dl, same = dl.to_numpy().astype(np.int32), keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
        head = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (dl[1:] != dl[:-1])]))  # rows of one key and length are one document
        own = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(dl))))
        words = w.flatten().dictionary_encode()
        # one number a pair of term and document, in the order of both
        pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(head) + np.repeat(own, dl), return_counts=True)
        term, doc = np.divmod(pair, len(head))
        first = np.append(np.searchsorted(term, np.arange(len(words.dictionary))), len(pair))
        doc, tf = np.concatenate([head[doc], np.arange(len(dl))]), np.concatenate([tf, dl]).astype(np.int32)
        postings = pa.StructArray.from_arrays([keys.take(pa.array(doc)), pa.array(tf), pa.array(dl[doc])], ["key", "tf", "dl"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), postings)
        terms = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([ALL])])
        fixed = [pa.array(np.full(len(first), x, np.int32)) for x in (batch, number)]
        bounds = pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl[doc], first))
        return pa.record_batch([terms, *fixed, *bounds, lists], names=["term", "batch", "shard", "max_tf", "min_dl", "list"])

    def run(batches):
        waiting, current = [], None
        for b in batches:
            numbers = b.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)] if len(numbers) else [0]
            for lo, hi in zip(edges, edges[1:]):
                if waiting and numbers[lo] != current:
                    yield shard(current, pa.Table.from_batches(waiting))
                    waiting = []
                current = int(numbers[lo])
                waiting.append(b.slice(lo, hi - lo))
        if waiting:
            yield shard(current, pa.Table.from_batches(waiting))

    return run


def _all_lists(docs: DataFrame, key: str, text: str, batch: int) -> DataFrame:
    """The postings of a batch with a list ``ALL`` for each shard; a document's words meet once, in its shard's task."""
    shards = max(1, math.ceil(docs.count() / SHARD_DOCS))
    rows = docs.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("key"), F.col(text).alias("text"))
    dealt = rows.repartition(min(shards, 4096), "shard").sortWithinPartitions("shard")
    words = dealt.select("shard", "key", F.coalesce(X.tokens(F.col("text")), F.array().cast("array<string>")).alias("w"))
    kind = dict(rows.dtypes)["key"]
    return words.mapInArrow(_lists(batch), f"term string, batch int, shard int, max_tf int, min_dl int, list array<struct<key:{kind},tf:int,dl:int>>")


def _parts(lists: DataFrame, batch: int) -> Index:
    lengths = lists.filter(F.col("term") == ALL).select(F.explode("list").alias("d")).groupBy(F.col("d.dl").cast("long").alias("dl")).agg(F.count("*").alias("docs")).withColumn("batch", F.lit(batch))
    own = lists.filter(F.col("term") != ALL)
    return Index(own, own.groupBy("term").agg(F.sum(F.size("list")).alias("df")).withColumn("batch", F.lit(batch)), lengths)


def blocks(docs: DataFrame, key: str, text: str, batch: int = 0) -> Index:
    """The index of a batch of documents; null and blank texts are documents of no terms."""
    return _parts(_all_lists(docs, key, text, batch), batch)


def append(docs: DataFrame, key: str, text: str, path: str, batch: int = 0) -> None:
    """Add a batch of new documents to the index at ``path``; what is there stays as it is.

    The texts are read and dealt once. Postings lie by shard and are sorted by
    term, so a file holds whole shards and its row groups tell which terms they
    have.
    """
    _all_lists(docs, key, text, batch).sortWithinPartitions("term", "shard").write.mode("append").parquet(f"{path}/postings")
    new = _parts(docs.sparkSession.read.parquet(f"{path}/postings").filter(F.col("batch") == batch), batch)
    new.terms.write.mode("append").parquet(f"{path}/terms")
    new.lengths.coalesce(1).write.mode("append").parquet(f"{path}/lengths")


def load(spark: SparkSession, path: str) -> Index:
    postings, terms, lengths = (spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "lengths"))
    return Index(postings.filter(F.col("term") != ALL), terms, lengths)


def _version(docs: DataFrame) -> str:
    """A hash of the names, sizes and times of the files that ``docs`` reads; no column is read for it."""
    f = F.col("_metadata")
    one = F.xxhash64(f["file_path"], f["file_size"], f["file_modification_time"])
    r = docs.select(one.alias("h")).distinct().agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 20)).alias("s")).first()
    return f"{r.n}-{(r.x or 0) & 0xFFFFFFFFFFFFFFFF:x}-{(r.s or 0) & 0xFFFFFFFFFFFFFFFF:x}"


def stored(docs: DataFrame, key: str, text: str, folder: str) -> Index:
    """The index of a table of files in ``folder``: built where there is none of just these files, else opened.

    It is built beside its place and moved there whole, so a half-built one is
    never opened and of two builders one wins.
    """
    spark = docs.sparkSession
    path = f"{folder}/postings-{key}-{text}-{_version(docs)}"
    to = spark._jvm.org.apache.hadoop.fs.Path
    fs = to(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(to(path)):
        made = f"{path}-{uuid.uuid4().hex}"
        append(docs, key, text, made)
        if not fs.rename(to(made), to(path)) or fs.exists(to(f"{path}/{made.rsplit('/', 1)[-1]}")):
            fs.delete(to(f"{path}/{made.rsplit('/', 1)[-1]}"), True)
            fs.delete(to(made), True)
        fs.deleteOnExit(to(path))
    return load(spark, path)


def weights(index: Index) -> tuple[DataFrame, Column]:
    """term, df, idf of the whole index and the mean length; of the postings nothing is read."""
    n = F.sum("docs")
    total, mean = index.lengths.agg(n.cast("double")).scalar(), index.lengths.agg(F.sum(F.col("dl") * F.col("docs")) / n).scalar()
    # no term is null; joins on it put the same filter here, so that floor and weights share one exchange
    raw = index.terms.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")).select("term", "df", F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg(F.lit(EPSILON) * F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), mean


class _Best:
    """The k best documents of every query so far, and those within rounding of the k-th."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.scores, self.keys = [np.zeros(0)] * n, [[] for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, keys: list) -> None:
        scores, keys = np.concatenate([self.scores[q], scores]), self.keys[q] + keys
        if len(scores) > self.k:
            self.floor[q] = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.flatnonzero(scores >= self.floor[q] - SLACK)
            scores, keys = scores[keep], [keys[i] for i in keep.tolist()]
        self.scores[q], self.keys[q] = scores, keys


def _impact(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def _score(q_key: str, held, k: int):
    """Rows (term, batch, shard, max_tf, min_dl, list) sorted by shard -> the task's best (query, key, score)."""

    def shard(rows: pa.Table, best: _Best, asked: dict, n: int, mean: float) -> None:
        terms = rows.column("term").to_pylist()
        top = _impact(rows.column("max_tf").to_numpy().astype(np.float64), rows.column("min_dl").to_numpy().astype(np.float64), mean)
        bound, open_ = np.zeros(n), np.zeros(n, bool)
        for t, x in zip(terms, top.tolist()):
            q, w = asked[t]
            bound[q] += np.maximum(w, 0.0) * x
            open_[q] |= w <= 0
        # a weight of zero or less takes part in scores, not in bounds: such queries are scored wherever they have a term
        live = open_ | ((bound > 0) & (bound >= best.floor - SLACK))
        if not live.any():
            return
        flat = rows.column("list").combine_chunks()
        offsets, flat = flat.offsets.to_numpy() - flat.offsets[0].as_py(), flat.flatten()
        keys = flat.field("key").dictionary_encode()
        at, impact = keys.indices.to_numpy(), _impact(flat.field("tf").to_numpy().astype(np.float64), flat.field("dl").to_numpy().astype(np.float64), mean)
        place = np.cumsum(live) - 1
        total, hit = np.zeros((int(live.sum()), len(keys.dictionary))), np.zeros((int(live.sum()), len(keys.dictionary)), bool)
        for i, t in enumerate(terms):
            q, w = asked[t]
            q, w = q[live[q]], w[live[q]]
            if len(q):
                cells = np.ix_(place[q], at[offsets[i] : offsets[i + 1]])
                total[cells] += w[:, None] * impact[None, offsets[i] : offsets[i + 1]]
                hit[cells] = True
        for q in np.flatnonzero(live).tolist():
            row = total[place[q]]
            near = np.flatnonzero(hit[place[q]] & (row >= best.floor[q] - SLACK))
            if len(near) > 4 * k:
                near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k] - SLACK]
            if len(near):
                best.add(q, row[near], keys.dictionary.take(pa.array(near)).to_pylist())

    def run(batches):
        names, asked, mean = held.value
        best, waiting, current = _Best(len(names), k), [], None
        for b in batches:
            ids = list(zip(b.column("batch").to_pylist(), b.column("shard").to_pylist()))
            lo = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[lo]:
                    if waiting and ids[lo] != current:
                        shard(pa.Table.from_batches(waiting), best, asked, len(names), mean)
                        waiting = []
                    current = ids[lo]
                    waiting.append(b.slice(lo, i - lo))
                    lo = i
        if waiting:
            shard(pa.Table.from_batches(waiting), best, asked, len(names), mean)
        for q, name in enumerate(names):
            if len(best.scores[q]):
                yield pa.record_batch([pa.array([name] * len(best.scores[q])), pa.array(best.keys[q]), pa.array(best.scores[q])], names=[q_key, "key", "score"])

    return run


def search(index: Index, queries: DataFrame, q_key: str, q_text: str, k: int, digits: int = 6) -> DataFrame:
    """q_key, key, score, rank: the k best documents of each query, exactly as scoring every document gives them.

    Queries go to the tasks in blocks of ``ASKED_TERMS`` terms, one pass over
    their blocks of postings each. Scores are rounded to ``digits``, ties go to
    the smaller key; documents without a term of the query are not ranked, and
    queries without terms have no rows.
    """
    spark = queries.sparkSession
    wanted = queries.select(q_key, F.explode(X.tokens(F.col(q_text))).alias("term")).groupBy(q_key, "term").agg(F.count("*").alias("qtf"))
    idf, mean = weights(index)
    plans = wanted.join(idf, "term").groupBy(q_key).agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("terms"), F.first(mean).alias("mean"))
    kinds = dict(queries.dtypes)[q_key], next(f for f in index.postings.schema["list"].dataType.elementType.fields if f.name == "key").dataType.simpleString()
    schema = f"{q_key} {kinds[0]}, key {kinds[1]}, score double"

    def one_pass(block: list) -> DataFrame:
        asked: dict[str, list] = {}
        for i, r in enumerate(block):
            for term, weight in r.terms:
                asked.setdefault(term, []).append((i, weight))
        plan = {t: (np.array([i for i, _ in rows]), np.array([w for _, w in rows])) for t, rows in asked.items()}
        held = spark.sparkContext.broadcast(([r[0] for r in block], plan, float(block[0].mean)))
        terms = F.broadcast(spark.createDataFrame([(t,) for t in plan], "term string"))  # ASKED_TERMS and one query's at most
        met = index.postings.select("term", "batch", "shard", "max_tf", "min_dl", "list").join(terms, "term", "left_semi")
        return met.repartition("batch", "shard").sortWithinPartitions("batch", "shard").mapInArrow(_score(q_key, held, k), schema)

    passes, block, size = [], [], 0
    for r in plans.toLocalIterator():
        block.append(r)
        size += len(r.terms)
        if size >= ASKED_TERMS:
            passes.append(one_pass(block))
            block, size = [], 0
    if block:
        passes.append(one_pass(block))
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
    return top_k(found.withColumn("score", F.bround("score", digits)), q_key, k, F.col("score").desc(), F.col("key"))
