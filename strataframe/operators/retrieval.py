"""Lexical and vector retrieval, fusion, boosts, ordering and evaluation."""

from __future__ import annotations

import random
import time
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions import text as X
from strataframe.functions.query import entities

# Fixed values of the public Okapi formula, fusion and boosts.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Parts of a term's documents in a scan whose queries are not broadcast.
SALTS = 64
#: Words of queries that a scan broadcasts at most.
HELD_TERMS = 50_000
BOOSTS = {"standard": 0.20, "year": 0.10, "clause": 0.15, "amendment": 0.10}


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """term, df over all documents; a term ' <n>' counts the documents of n terms.

    Terms hold no spaces, so lengths pass through the same map-side combined
    count, and one pass over the texts gives frequencies, number and mean.
    """
    words = docs.select(F.coalesce(X.tokens(F.col(text)), F.array().cast("array<string>")).alias("w"))  # by itself, so that it is made once
    each = F.array_append(F.array_distinct("w"), F.concat(F.lit(" "), F.size("w").cast("string")))
    # explode_outer: plain explode would evaluate its array once more, to filter out the empty ones
    # no term is null; joins on it put the same filter here, so that all who read the counts share one exchange
    return words.select(F.explode_outer(each).alias("term")).filter(F.col("term").isNotNull()).groupBy("term").agg(F.count("*").alias("df"))


def idf(counts: DataFrame) -> tuple[DataFrame, Column]:
    """term, idf from ``term_counts``, and the mean length: terms in over half of the documents get epsilon times the mean idf."""
    # conditions on the term stand inside the aggregates: as filters they would go down to the texts, which then are read once for each
    is_length = F.startswith("term", F.lit(" "))
    docs = F.sum(F.when(is_length, F.col("df")))
    words = F.sum(F.when(is_length, F.col("df") * F.trim("term").cast("long")))
    total, mean = counts.agg(docs.cast("double")).scalar(), counts.agg(words / docs).scalar()
    raw = counts.select("term", F.when(~is_length, F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("raw"))
    floor = raw.agg(F.lit(EPSILON) * F.avg("raw")).scalar()
    return raw.filter(F.col("raw").isNotNull()).select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf")), mean


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, q_key: str, q_text: str) -> DataFrame:
    """q_key, key, score of all documents that share a term with a query.

    Two passes over the texts: one for the statistics of all documents, one
    whose words are cut to those of the queries before anything is grouped.
    The parts of a document's scores meet in its own task, where up to
    ``HELD_TERMS`` words of queries are broadcast; more are joined by shuffle.
    """
    wanted = queries.select(q_key, F.explode(X.tokens(F.col(q_text))).alias("term")).groupBy(q_key, "term").agg(F.count("*").alias("qtf"))
    terms = wanted.select("term").distinct()
    words = docs.select(F.col(key), X.tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), "w")
    tf = words.select(key, "dl", F.explode_outer("w").alias("term")).join(terms, "term", "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    weights, mean = idf(term_counts(docs, text))
    asked = wanted.join(weights, "term")
    if _held(wanted):
        hit = tf.repartition(key).join(F.broadcast(asked), "term")
    else:
        # a frequent word of many documents meets its queries in SALTS tasks, not in one
        asked = asked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = tf.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(asked, ["term", "__salt"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    return hit.groupBy(q_key, key).agg(F.sum(part).alias("score"))


def _held(wanted: DataFrame) -> bool:
    """Whether the words of the queries are few enough to broadcast, and the session broadcasts at all."""
    off = wanted.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().startswith("-")
    return not off and wanted.limit(HELD_TERMS + 1).count() <= HELD_TERMS


def top_k(df: DataFrame, per: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; Spark limits groups before the shuffle."""
    w = Window.partitionBy(per).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


#: Query vectors that go to the tasks at once, and the sides of a block of distances.
QUERY_BLOCK, TILE, ROWS = 20_000, 256, 2048


def _nearest(qid: np.ndarray, qv: np.ndarray, own: np.ndarray, v: np.ndarray, k: int):
    """(query, row, distance) of the k nearest rows of every query, ties by id."""
    d = np.maximum((qv**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * qv @ v.T, 0.0)
    r = np.round(d, 9)
    m = min(k, len(own))
    limit = np.partition(r, m - 1, axis=1)[:, m - 1]
    q, c = np.nonzero(r <= limit[:, None])  # ties at the limit stay in until they are sorted
    order = np.lexsort((own[c], r[q, c], q))
    q, c = q[order], c[order]
    first = np.searchsorted(q, np.arange(len(qid)))
    keep = np.arange(len(q)) - first[q] < m
    return qid[q[keep]], own[c[keep]], d[q[keep], c[keep]]


def knn(corpus: DataFrame, key: str, vector: str, queries: DataFrame, q_key: str, q_vector: str, k: int) -> DataFrame:
    """q_key, key, distance, score = 1 / (1 + squared L2), the k nearest of each query, exactly.

    Queries go to the tasks in blocks of ``QUERY_BLOCK``, one pass over the
    corpus each; each batch of the corpus keeps its k best for every query, in
    tiles of bounded size, so the shuffle carries k rows a batch and query,
    never the pairs. NULL vectors match nothing.
    """
    spark = queries.sparkSession
    vectors = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)

    def one_pass(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), np.array([r[1] for r in block], np.float64)))

        def run(batches):
            qid, qv = held.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    own = b.column(0).to_numpy()
                    v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    for lo in range(0, len(qid), TILE):
                        found = _nearest(qid[lo : lo + TILE], qv[lo : lo + TILE], own, v, k)
                        yield pa.record_batch([pa.array(x) for x in found], names=[q_key, key, "distance"])

        return vectors.mapInArrow(run, f"{q_key} long, {key} long, distance double")

    rows = iter(queries.filter(F.col(q_vector).isNotNull()).select(q_key, q_vector).toLocalIterator())
    passes = []
    while block := list(islice(rows, QUERY_BLOCK)):
        passes.append(one_pass(block))
    found = reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], f"{q_key} long, {key} long, distance double")
    return top_k(found, q_key, k, F.round("distance", 9), F.col(key)).withColumn("score", 1 / (1 + F.col("distance")))


def fuse(dense: DataFrame, lexical: DataFrame, q_key: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked arms: score, both ranks, and which arms found the row."""
    d = dense.select(q_key, key, F.col("rank").alias("dense_rank"))
    b = lexical.select(q_key, key, F.col("rank").alias("bm25_rank"))
    both = d.join(b, [q_key, key], "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    methods = F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("bm25_rank").isNotNull(), "bm25")))
    return both.withColumn("fusion", part("dense_rank") + part("bm25_rank")).withColumn("methods", methods)


def rank_fusion(lists: list[DataFrame], q_key: str, key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over any number of ranked lists."""
    every = reduce(DataFrame.unionByName, [x.select(q_key, key, "rank") for x in lists])
    return every.groupBy(q_key, key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fusion"))


def boost(df: DataFrame, q_key: str, score: str, standard: Column, year: Column, clause: Column, amendment: Column) -> DataFrame:
    """Add shares of the query's best score for matching identifiers; the year counts only with the standard.

    A best score of zero or less counts as one. Rows with a match get
    "identifier" among their ``methods``, where there is such a column.
    """
    most = F.max(score).over(Window.partitionBy(q_key))
    no = lambda c: F.coalesce(c, F.lit(False))
    one = lambda c, v: F.when(no(c), v).otherwise(0.0)
    share = one(standard, BOOSTS["standard"]) + one(no(standard) & no(year), BOOSTS["year"]) + one(clause, BOOSTS["clause"]) + one(amendment, BOOSTS["amendment"])
    out = df.withColumn("__share", share).withColumn("boosted", F.col(score) + F.when(most > 0, most).otherwise(1.0) * F.col("__share"))
    if "methods" in df.columns:
        out = out.withColumn("methods", F.when(F.col("__share") > 0, F.array_union("methods", F.array(F.lit("identifier")))).otherwise(F.col("methods")))
    return out.drop("__share")


def tiers(df: DataFrame, q_key: str, keys: list[Column], tie: Column) -> DataFrame:
    """Rank by several descending keys, then one ascending."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(q_key).orderBy(*[k.desc() for k in keys], tie.asc())).cast("long"))


def min_max(df: DataFrame, per: str, score: str) -> DataFrame:
    """Scores scaled to 0..1 in each group; all equal gives 1, or 0 when they are about 0."""
    w = Window.partitionBy(per)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(hi - lo < 1e-12, F.when(F.abs(hi) < 1e-12, 0.0).otherwise(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def keep_first(df: DataFrame, order: list[Column], *keys: Column) -> DataFrame:
    """The first row of each key; NULLs are equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def evaluate(ranked: DataFrame, gold: DataFrame, q_key: str, key: str, k: int) -> DataFrame:
    """recall and reciprocal rank at k of each query with gold rows."""
    g = gold.select(q_key, key).distinct()
    hits = g.join(ranked.filter(F.col("rank") <= k).select(q_key, key, "rank"), [q_key, key], "left")
    return hits.groupBy(q_key).agg((F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def texts_containing(docs: DataFrame, key: str, text: str, items: DataFrame, i_key: str, i_text: str) -> DataFrame:
    """i_key, key where the document contains the item, blocked on the item's rarest inner word."""
    inner = items.select(i_key, F.split(i_text, r"\s+").alias("w"))
    words = inner.select(i_key, F.explode(F.when(F.size("w") > 2, F.slice("w", 2, F.size("w") - 2)).otherwise(F.col("w"))).alias("term")).distinct()
    posts = docs.select(key, F.explode_outer(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("term"))
    # dealt by term once: the counts and the look-up read the same exchange, as both need the key and neither drops its nulls
    posts = posts.join(words.select("term").distinct(), "term", "left_semi").repartition("term")
    df = posts.groupBy("term").agg((F.count(key) + F.count_if(F.col(key).isNull())).alias("df"))
    rare = words.join(df, "term").groupBy(i_key).agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    # a struct of the key is never null, so no filter on the key goes down to the posts; null keys end here, at the texts
    found = posts.join(rare, "term").select(i_key, F.struct(key).alias("__doc"))
    whole = docs.filter(F.col(key).isNotNull()).select(key, F.struct(key).alias("__doc"), F.col(text).alias("__text"))
    return found.join(items.select(i_key, F.col(i_text).alias("__item")), i_key).join(whole, "__doc").filter(F.contains("__text", "__item")).select(i_key, key)


def embed(df: DataFrame, text: str, model, out: str = "embedding", dim: int | None = None) -> DataFrame:
    """``df`` with vectors of a caller's model: a function from a list of texts to rows of floats.

    It runs over Arrow batches on the executors; NULL texts get NULL, and with
    ``dim`` a vector of another length is an error.
    """

    @F.pandas_udf("array<float>")
    def run(col: pd.Series) -> pd.Series:
        some = col.notna().to_numpy()
        rows = [list(map(float, r)) for r in model(col[some].tolist())] if some.any() else []
        if len(rows) != some.sum() or dim is not None and any(len(r) != dim for r in rows):
            raise ValueError("the model returned vectors of another shape")
        it = iter(rows)
        return pd.Series([next(it) if x else None for x in some.tolist()])

    return df.withColumn(out, run(F.col(text)))


def rescore(df: DataFrame, q_text: str, text: str, model, out: str = "reranker") -> DataFrame:
    """``df`` with scores of a caller's pair model: a function from a list of (query, text) to floats."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(map(float, model(list(zip(a.fillna(""), b.fillna("")))))) if len(a) else [], dtype="float64")

    return df.withColumn(out, run(F.col(q_text), F.col(text)))


def rewritten(df: DataFrame, prompt: Column, model, out: str, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """``df`` with the replies of a caller's text model (prompt -> text), NULL where it fails ``tries`` times.

    Waits a random share of ``pause`` x 2^n between tries.
    """

    def reply(p: str) -> str | None:
        for n in range(tries):
            try:
                return model(p)
            except Exception:  # noqa: BLE001  the caller's model may raise anything
                if n + 1 < tries:
                    time.sleep(random.random() * pause * 2**n)
        return None

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else reply(p) for p in col], dtype=object)

    return df.withColumn(out, run(prompt))


def retrieve(docs: DataFrame, key: str, text: str, queries: DataFrame, q_key: str, q_text: str, dense: DataFrame, k: int = 10, pool: int = 50, scope: Column | None = None, identity: dict[str, Column] | None = None, lexical=None) -> DataFrame:
    """q_key, key, fusion, methods, boosted, rank: the whole retrieval of a batch of queries.

    Queries are normalised and their identifiers read; the words' arm and the
    caller's ranked ``dense`` arm (q_key, key, rank), which ``scope`` alone
    limits, give ``pool`` rows each, are fused by reciprocal ranks, boosted
    where identifiers agree (``identity``: columns of the documents, by default
    the first standard that the text names), left once for each content, and
    cut to ``k``. The words' arm scans the texts, or is ``lexical``: a function
    of the normalised queries, their key and text and the pool to q_key, key,
    rank, as a stored index gives it.
    """
    asked = queries.select(q_key, X.normalize_query(F.col(q_text)).alias("__asked")).withColumn("__e", entities(F.col("__asked")))
    if scope is not None:
        dense = dense.join(docs.filter(scope).select(key), key, "left_semi")
    no = F.lit(None).cast("string")
    own = {"standard": F.nullif(F.regexp_extract(text, r"(?i)\bIS[\s:\-]*(\d{1,6})", 1), F.lit(""))} if identity is None else identity
    facts = docs.select(F.col(key), F.sha2(F.col(text), 256).alias("__h"), *[own.get(f, no).cast("string").alias(f"__{f}") for f in BOOSTS])
    if lexical is None:
        scored = bm25(docs, key, text, asked, q_key, "__asked").withColumn("score", F.bround("score", 6))
        words = top_k(scored, q_key, pool, F.col("score").desc(), F.col(key))
    else:
        words = lexical(asked, q_key, "__asked", pool)
    fused = fuse(dense.filter(F.col("rank") <= pool), words, q_key, key).withColumn("fusion", F.bround("fusion", 8))
    marked = fused.join(facts, key).join(asked.drop("__asked"), q_key)
    e = lambda f: F.col(f"__e.{f}").cast("string")
    agree = [F.col("__standard") == e("number"), F.col("__year") == e("year"), F.col("__clause") == e("clause"), F.col("__amendment") == e("amendment")]
    boosted = boost(marked, q_key, "fusion", *agree).withColumn("boosted", F.bround("boosted", 8))
    order = [F.col("boosted").desc(), F.col(key)]
    return top_k(keep_first(boosted, order, F.col(q_key), F.col("__h")), q_key, k, *order).select(q_key, key, "fusion", "methods", "boosted", "rank")


def extractive_answer(df: DataFrame, key: str, order: list[Column], heading: Column, content: str, most: int = 4, lines: int = 14, chars: int = 200, consumer: bool = False) -> DataFrame:
    """key, answer, claims (claim_id, text, citation) from the first ``most`` distinct contents of each key.

    Every content shows its first filled lines, and says so when there are
    more; its first line, cut to ``chars``, is a claim that cites it. For
    consumers clause numbers are left out of headings and texts.
    """
    bare = (lambda c: F.trim(F.regexp_replace(c, r"(?i)\bClause\s*\d+(?:\.\d+)*\b", ""))) if consumer else (lambda c: c)
    own = df.select(key, *[o.alias(f"__o{i}") for i, o in enumerate(order)], F.coalesce(F.nullif(bare(heading), F.lit("")), F.lit("")).alias("__head"), F.col(content).alias("__text"))
    places = [F.col(f"__o{i}") for i in range(len(order))]
    first = top_k(keep_first(own, places, F.col(key), F.sha2("__text", 256)), key, most, *places)
    rows = F.filter(F.transform(F.split(bare(F.coalesce("__text", F.lit(""))), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    i = F.col("rank").cast("string")
    blank = F.concat(F.lit("Quality and Safety Feature " if consumer else "Requirement Section "), i)
    head = F.when(F.col("__head") == "", blank).otherwise(F.col("__head"))
    shown = F.concat(F.array_join(F.slice("__rows", 1, lines), "\n"), F.when(F.size("__rows") > lines, "\n*(additional requirements in source document)*").otherwise(""))
    part = F.concat(F.lit("- **"), head, F.lit("**: "), shown) if consumer else F.concat(F.lit("#### "), i, F.lit(". "), head, F.lit(" [EV"), i, F.lit("]\n\n"), shown)
    claim = F.struct(F.concat(F.lit("C"), i).alias("claim_id"), F.substring(F.coalesce(F.get("__rows", F.lit(0)), head), 1, chars).alias("text"), F.concat(F.lit("EV"), i).alias("citation"))
    ready = first.withColumn("__rows", rows).select(key, "rank", part.alias("p"), claim.alias("c"))
    g = ready.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "p", "c"))).alias("x"))
    sources = F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["c"]["citation"], F.lit("]"))), ", ")
    return g.select(key, F.concat(F.array_join(F.transform("x", lambda r: r["p"]), "\n\n"), F.lit("\n\nSources: "), sources).alias("answer"), F.transform("x", lambda r: r["c"]).alias("claims"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """array<double>: unit vector of hashed token counts, a stand-in for a model that the caller brings."""
    slots = F.transform(X.tokens(text), lambda t: F.crc32(t) % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.size(slots) > 0, F.element_at(F.transform(F.array(counts), lambda v: F.transform(v, lambda x: x / norm(v))), 1))
