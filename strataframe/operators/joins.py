"""Joins with the semantics of document knowledge: links, references, wildcard keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.functions import text as X
from strataframe.operators.patterns import occurring


def linked(targets: DataFrame, key: str, edges: DataFrame, edge_type: str, source: Column) -> DataFrame:
    """Targets of edges of one type whose source fits: filtered before the join, distinct after."""
    ends = edges.filter((F.col("edge_type") == edge_type) & source).select(F.col("target_id").alias("__end")).distinct()
    return targets.join(ends, F.col(key) == F.col("__end"), "left_semi").distinct()


def wildcard_part(left: DataFrame, right: DataFrame, base: str, r_base: str, part: str, r_part: str) -> DataFrame:
    """Equal base numbers; a NULL part number on either side fits any part."""
    fits = F.col(part).isNull() | F.col(r_part).isNull() | (F.col(part) == F.col(r_part))
    return left.join(right, (F.col(base) == F.col(r_base)) & fits)


def resolve_links(chunks: DataFrame, identity: str, targets: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """link (resolved, unlinked or dangling) and the names of missing targets."""
    df = chunks
    for frame, pk, fk in targets.values():
        df = df.join(frame, F.col(fk) == F.col(pk), "left")
    absent = F.array_compact(F.array(*[F.when(F.col(identity) & F.col(pk).isNull(), F.lit(name)) for name, (_, pk, _) in targets.items()]))
    return df.withColumn("missing", absent).withColumn("link", F.when(~F.col(identity), "unlinked").when(F.size("missing") > 0, "dangling").otherwise("resolved"))


def reverse_list(df: DataFrame, owner: str, items: str, item: str, out: str) -> DataFrame:
    """From owner -> items to item -> sorted distinct owners."""
    return df.select(F.col(owner), F.explode(items).alias(item)).groupBy(item).agg(F.array_sort(F.collect_set(owner)).alias(out))


def with_parent(clauses: DataFrame, scope: str, number: str) -> DataFrame:
    """Each clause with the clause of the same scope whose number is its own without the last part."""
    parents = clauses.select(F.col(scope).alias("__scope"), F.col(number).alias("parent"))
    return clauses.join(parents, (F.col(scope) == F.col("__scope")) & (X.parent_clause(F.col(number)) == F.col("parent")), "left").drop("__scope")


def references(df: DataFrame, key: str, text: str, known: DataFrame, number: str, own: Column | None = None) -> DataFrame:
    """Distinct standards that a text mentions beside its ``own`` number, RESOLVED where they are known."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(X.STANDARD), F.lit(1)), lambda n: F.concat(F.lit("IS "), n)))
    if own is not None:
        found = F.array_remove(found, F.coalesce(own, F.lit("")))
    exploded = df.select(key, F.explode(found).alias("reference"))
    k = known.select(F.col(number).alias("__known")).distinct()
    return exploded.join(k, F.col("reference") == F.col("__known"), "left").select(key, "reference", F.when(F.col("__known").isNull(), "UNRESOLVED").otherwise("RESOLVED").alias("state"))


def either_end(nodes: DataFrame, key: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes with the edges at either of their ends: two equi-joins instead of one OR."""
    first = nodes.join(edges, F.col(key) == F.col(a))
    second = nodes.join(edges.filter(~F.col(a).eqNullSafe(F.col(b))), F.col(key) == F.col(b))
    return first.unionByName(second)


def citations(df: DataFrame, key: str, ids: str, evidence: DataFrame, evidence_id: str) -> DataFrame:
    """One row per cited id; unknown where no evidence has it."""
    e = evidence.select(F.col(evidence_id).alias("__id")).distinct()
    return df.select(key, F.explode(ids).alias("cited")).join(e, F.col("cited") == F.col("__id"), "left").select(key, "cited", F.col("__id").isNull().alias("unknown"))


def add_missing(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return found.withColumn("origin", F.lit("found")).unionByName(known.join(found, key, "left_anti").withColumn("origin", F.lit("known")))


def rejected(candidates: DataFrame, kept: DataFrame, key: str, reason: Column) -> DataFrame:
    return candidates.join(kept.select(key), key, "left_anti").select(key, reason.alias("reason"))


def unseen_content(new: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    """Rows whose content hash has not been ingested."""
    h = seen.select(F.sha2(column, 256).alias("__hash")).distinct()
    return new.withColumn("__own", F.sha2(column, 256)).join(h, F.col("__own") == F.col("__hash"), "left_anti").drop("__own")


def competing(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one member, and a stable id of the conflict."""
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members")).filter(F.size("members") > 1)
    return grouped.withColumn("conflict_id", X.digest(F.concat_ws(":", F.col(key).cast("string"), F.array_join(F.col("members").cast("array<string>"), ",")), 16))


def evolution(base: DataFrame, target: DataFrame, key: str, title: str) -> DataFrame:
    """Clauses added, removed, modified or unchanged between two versions."""
    b = base.select(F.col(key).alias("b_key"), F.col(title).alias("b_title"))
    n = target.select(F.col(key).alias("t_key"), F.col(title).alias("t_title"))
    same = F.lower(F.trim("b_title")) == F.lower(F.trim("t_title"))
    change = F.when(F.col("b_key").isNull(), "added").when(F.col("t_key").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return b.join(n, F.col("b_key") == F.col("t_key"), "full").select(F.coalesce("b_key", "t_key").alias(key), change.alias("change"))


# Names of one quantity, and words that identify none.
SYNONYMS = (("capacity", "volume", "storage"), ("temperature", "temp"), ("pressure",), ("thickness",), ("diameter",), ("efficiency",), ("voltage",), ("current",), ("power",), ("frequency",), ("conductivity", "resistance"), ("scale", "range"))
STOP = ("the", "of", "and", "shall", "be", "at", "not", "nominal", "maximum", "minimum", "operating", "working", "allowable")
TENDER_SYNONYMS = (
    ("capacity", "volume", "storage"), ("temperature", "temp", "thermal"), ("pressure", "hydrostatic"), ("thickness",), ("diameter",), ("efficiency",), ("noise", "acoustic"), ("material", "grade", "polyethylene", "steel"), ("test", "testing", "inspection"),
    ("certification", "conformance", "license", "licence", "isi"), ("dimension", "size", "width", "length", "height"), ("warranty",), ("delivery",), ("weight",),
)
TENDER_STOP = (
    "the", "of", "and", "shall", "be", "at", "not", "is", "a", "an", "for", "with", "in", "to", "exceed", "least", "less", "than", "between", "maximum", "minimum", "must", "as", "per",
    "from", "unit", "total", "only", "all", "strictly", "required", "submitted", "maintained", "records", "testing", "order", "timeline", "valid", "routine",
)


def _words(c: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+"), ""))


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _groups(words: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """The numbers of the groups that have one of the words."""
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in g])), i) for i, g in enumerate(groups)]))


def _name_parts(name: Column, words: Column) -> Column:
    """struct<low, words, groups> of a parameter name and its words: all that a comparison needs of one side."""
    return F.struct(F.lower(F.trim(name)).alias("low"), F.array_except(words, F.array(*[F.lit(w) for w in STOP])).alias("words"), _groups(words, SYNONYMS).alias("groups"))


def _tier(a: Column, b: Column) -> Column:
    shared = F.arrays_overlap(a["words"], b["words"]) | F.arrays_overlap(a["groups"], b["groups"])
    return F.when(a["low"] == b["low"], 1).when(_either_contains(a["low"], b["low"]), 2).when(shared, 3)


def match_tier(a: Column, b: Column) -> Column:
    """How two parameter names fit: 1 equal, 2 one inside the other, 3 a shared word or synonym, NULL not at all."""
    return _tier(X.let(_words(a), lambda w: _name_parts(a, w)), X.let(_words(b), lambda w: _name_parts(b, w)))


def match_parameters(left: DataFrame, l_key: str, l_scope: str, l_name: str, right: DataFrame, r_key: str, r_scope: str, r_name: str, r_pos: str) -> DataFrame:
    """l_key, r_key, tier: each requirement's parameter within its scope (a product), the best tier, then the first; NULL where none fits.

    Rows meet by an equi-join on the scope, whose parameters are few; nothing is compared across scopes.
    """
    parts = lambda df, name, *keys: df.withColumn("__words", _words(F.col(name))).select(*keys, _name_parts(F.col(name), F.col("__words")).alias("__parts"))
    r = parts(right, r_name, F.col(r_scope).alias("__scope"), r_key, F.col(r_pos).alias("__pos")).withColumnRenamed("__parts", "__right")
    asked = parts(left, l_name, l_key, l_scope).withColumnRenamed("__parts", "__left")
    pairs = asked.join(r, F.col(l_scope) == F.col("__scope")).withColumn("tier", _tier(F.col("__left"), F.col("__right"))).filter("tier IS NOT NULL")
    best = pairs.groupBy(l_key).agg(F.min_by(F.struct(r_key, "tier"), F.struct("tier", "__pos", r_key)).alias("b")).select(F.col(l_key).alias("__l"), f"b.{r_key}", "b.tier")
    return left.select(l_key).join(best, F.col(l_key) == F.col("__l"), "left").select(l_key, r_key, "tier")


def _tender_words(name: Column, text: Column) -> Column:
    return F.array_except(F.array_union(_words(name), _words(text)), F.array(*[F.lit(w) for w in TENDER_STOP]))


def _tender_parts(name: Column, text: Column, words: Column) -> Column:
    """struct<low, text, long, groups> of a requirement and its words: all that a comparison needs of one side."""
    return F.struct(F.lower(F.trim(name)).alias("low"), F.lower(text).alias("text"), F.filter(words, lambda w: F.length(w) >= 4).alias("long"), _groups(words, TENDER_SYNONYMS).alias("groups"))


def _tender_fit(a: Column, category: Column, b: Column) -> Column:
    kind = F.nullif(F.lower(category), F.lit(""))
    by_category = F.coalesce(F.contains(b["low"], kind) | F.contains(b["text"], kind), F.lit(False))
    return _either_contains(a["low"], b["low"]) | F.arrays_overlap(a["long"], b["long"]) | F.arrays_overlap(a["groups"], b["groups"]) | by_category


def tender_fits(a_name: Column, a_text: Column, category: Column, b_name: Column, b_text: Column) -> Column:
    """Does a tender's requirement concern a standard's: by containment, a word of four letters or more, a synonym or its category."""
    one = lambda name, text: X.let(_tender_words(name, text), lambda w: _tender_parts(name, text, w))
    return _tender_fit(one(a_name, a_text), category, one(b_name, b_text))


def tender_links(left: DataFrame, l_key: str, l_scope: str, l_name: str, l_text: str, category: str, right: DataFrame, r_key: str, r_scope: str, r_name: str, r_text: str) -> DataFrame:
    """l_key, r_key: every fitting requirement within the scope (the candidate standard), or one row with NULL: a gap."""
    parts = lambda df, name, text, *keys: df.withColumn("__words", _tender_words(F.col(name), F.col(text))).select(*keys, _tender_parts(F.col(name), F.col(text), F.col("__words")).alias("__parts"))
    r = parts(right, r_name, r_text, F.col(r_scope).alias("__scope"), r_key).withColumnRenamed("__parts", "__right")
    asked = parts(left, l_name, l_text, F.col(l_key).alias("__l"), F.col(l_scope).alias("__own"), F.col(category).alias("__kind")).withColumnRenamed("__parts", "__left")
    pairs = asked.join(r, F.col("__own") == F.col("__scope")).filter(_tender_fit(F.col("__left"), F.col("__kind"), F.col("__right"))).select("__l", r_key)
    return left.select(l_key).join(pairs, F.col(l_key) == F.col("__l"), "left").select(l_key, r_key)


# Words that say nothing in a question or a title.
ASK_STOP = ("what", "does", "standard", "apply", "product", "need", "test", "order")
TITLE_STOP = ("specification", "requirements", "method", "safety", "general", "part", "section")


def _title_words(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)), lambda w: ~w.isin(*TITLE_STOP))


def catalogue_score(text: Column, products: Column, title: Column, category: Column, known: Column | None = None) -> Column:
    """How well a product description fits a catalogue row.

    For each product of the row 10 when the text has its name, else 8 when the
    name has a known product that the text has, else 3 for each of its words
    over three letters in the text; 2 for each word of the title and 1 for each
    of the category among the words of the text.
    """
    return X.let(_ask_parts(text), lambda a: X.let(_row_parts(products, title, category), lambda r: _catalogue_total(a, r, known)))


def _ask_parts(text: Column) -> Column:
    """struct<low, asked> of a description: its lower case and its words."""
    low = F.lower(text)
    return F.struct(low.alias("low"), F.filter(F.regexp_extract_all(low, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(*ASK_STOP)).alias("asked"))


def _long_words(p: Column) -> Column:
    return F.filter(F.split(p, r"\s+"), lambda w: F.length(w) > 3)


def _category_words(category: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(category, F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))


def _row_parts(products: Column, title: Column, category: Column) -> Column:
    """struct<products (name, words), title, category> of a catalogue row, cut into words once."""
    names = F.transform(products, lambda p: F.struct(F.lower(p).alias("name"), _long_words(F.lower(p)).alias("words")))
    return F.struct(names.alias("products"), _title_words(title).alias("title"), _category_words(category).alias("category"))


def _catalogue_total(a: Column, r: Column, known: Column | None) -> Column:
    low = a["low"]
    two = lambda k: F.slice(_long_words(k), 1, 2)
    there = lambda k: F.contains(low, k) | ((F.size(two(k)) >= 2) & F.forall(two(k), lambda w: F.contains(low, w)))
    is_known = (lambda p: F.exists(known, lambda k: (k != "") & F.contains(p, F.lower(k)) & there(F.lower(k)))) if known is not None else (lambda p: F.lit(False))
    hits = lambda p: F.size(F.filter(p["words"], lambda w: F.contains(low, w)))
    one = lambda p: F.when(F.contains(low, p["name"]), 10).when(is_known(p["name"]), 8).otherwise(3 * hits(p))
    total = F.aggregate(r["products"], F.lit(0), lambda acc, p: acc + one(p))
    among = lambda words: F.size(F.filter(words, lambda w: F.array_contains(a["asked"], w)))
    return total + 2 * among(r["title"]) + among(r["category"])


def match_catalogue(asks: DataFrame, q_key: str, q_text: str, catalogue: DataFrame, c_key: str, products: str, title: str, category: str, known: Column | None = None, least: int = 3) -> DataFrame:
    """q_key, c_key, score: the best catalogue row of each description, if it scores ``least``; ties go to the smaller key.

    A word of the catalogue can only count where it lies in the text, so the
    texts are searched for all words at once, in time linear in their length,
    and rows meet where they share one: every pair that can score is a
    candidate, no other is compared. Equal texts have equal scores and are
    compared once; both sides are cut into words before they meet.
    """
    names = F.flatten(F.transform(F.coalesce(F.col(products), F.array().cast("array<string>")), lambda p: F.split(F.lower(F.trim(p)), r"\s+")))
    words = F.array_distinct(F.array_remove(F.concat(names, _title_words(F.col(title)), _category_words(F.col(category))), ""))
    keys = catalogue.select(F.col(c_key), F.explode(words).alias("__w"))
    own = asks.select(F.col(q_key), F.sha2(F.col(q_text), 256).alias("__h"))
    texts = asks.filter(F.col(q_text).isNotNull()).groupBy(F.sha2(F.col(q_text), 256).alias("__t")).agg(F.first(q_text).alias("__text"))
    found = occurring(texts.select("__t", F.lower("__text").alias("__low")), "__t", "__low", keys, "__w")
    pairs = found.join(keys, F.col("pattern") == F.col("__w")).select("__t", c_key).distinct()
    said = texts.select(F.col("__t").alias("__q"), _ask_parts(F.col("__text")).alias("__ask"))
    rows = catalogue.select(F.col(c_key).alias("__c"), _row_parts(F.col(products), F.col(title), F.col(category)).alias("__row"))
    scored = pairs.join(said, F.col("__t") == F.col("__q")).join(rows, F.col(c_key) == F.col("__c"))
    scored = scored.select("__t", c_key, _catalogue_total(F.col("__ask"), F.col("__row"), known).alias("score"))
    first = F.min_by(F.struct(c_key, "score"), F.when(F.col("score") >= least, F.struct(-F.col("score"), F.col(c_key)))).alias("b")
    best = scored.groupBy("__t").agg(first).filter("b.score IS NOT NULL").select("__t", "b.*")
    return own.join(best, F.col("__h") == F.col("__t")).groupBy(q_key).agg(F.min_by(F.struct(c_key, "score"), F.struct(-F.col("score"), F.col(c_key))).alias("b")).select(q_key, f"b.{c_key}", "b.score")


def add_unseen_claims(claims: Column, extracted: Column) -> Column:
    """``claims`` and, in order, the extracted ones that neither contain nor lie in any claim kept before them, whatever their case."""
    fresh = lambda acc, x: ~F.exists(acc, lambda e: _either_contains(F.lower(e), F.lower(x)))
    return F.aggregate(F.coalesce(extracted, F.array().cast("array<string>")), F.coalesce(claims, F.array().cast("array<string>")), lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def unsupported_pairs(left: DataFrame, l_scope: str, l_text: str, right: DataFrame, r_scope: str, r_text: str) -> DataFrame:
    """Rows of ``left`` whose text neither contains nor lies in a text of the same scope: an anti-join both ways."""
    r = right.select(F.col(r_scope).alias("__scope"), F.lower(r_text).alias("__r")).distinct()
    return left.join(r, (F.col(l_scope) == F.col("__scope")) & _either_contains(F.lower(l_text), F.col("__r")), "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
