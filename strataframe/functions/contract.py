"""The contract of a chunk's index metadata: which fields it has, of which type, and what they say together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataframe.functions import text as X

# The version, the fields with their types, and those that may not be empty.
VERSION = "6.0"
FIELDS = {
    "schema_version": "str", "chunk_id": "str", "document_id": "str", "source_hash": "str", "source_file": "str", "content_hash": "str", "chunk_index": "int", "source_content": "str",
    "contextualized_content": "str", "context_generation_method": "str", "context_generation_version": "str", "page_start": "int", "page_end": "int", "page_number": "int",
    "char_offset_start": "int", "char_offset_end": "int", "section": "str", "heading_context": "str", "clause_id": "str", "clause_title": "str", "standard_id": "str", "version_id": "str",
    "knowledge_clause_id": "str", "standard_relation": "str", "standard_number": "str", "standard_title": "str", "standard_year": "int", "edition_or_version": "str", "part": "str",
    "part_number": "str", "amendment": "str", "amendment_number": "str", "authority": "str", "document_type": "str", "source_url": "str", "effective_date": "str", "is_current": "str", "parser_version": "str",
}
REQUIRED = ("schema_version", "chunk_id", "document_id", "source_content", "contextualized_content", "standard_relation")
RELATIONS = ("identity", "none", "reference")
UNKNOWN_INT = -1
TYPES = {"STRING": "str", "BIGINT": "int", "BOOLEAN": "bool", "DOUBLE": "float"}


def _listed(names: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(F.array_sort(names), "', '"), F.lit("']"))


def contract_problems(metadata: Column) -> Column:
    """array<string>: how a metadata object (JSON text) departs from the contract, in the contract's order; empty where it holds.

    Text that is no JSON object has none of the fields.
    """
    return X.let(F.coalesce(F.from_json(metadata, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")), _problems)


def _problems(m: Column) -> Column:
    names = F.array(*[F.lit(n) for n in FIELDS])
    kinds = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])
    text = lambda n: F.try_variant_get(F.try_element_at(m, n), "$", "string")
    of = lambda name: text(F.lit(name))
    number = lambda name: F.nullif(F.trim(of(name)).try_cast("long"), F.lit(UNKNOWN_INT).cast("long"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def of_type(n: Column) -> Column:
        kind = F.schema_of_variant(F.try_element_at(m, n))
        known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
        found = F.coalesce(F.try_element_at(known, kind), F.when(F.startswith(kind, F.lit("DECIMAL")), "float").when(F.startswith(kind, F.lit("ARRAY")), "list").otherwise("dict"))
        want = F.element_at(kinds, n)
        return F.when(kind == "VOID", say("field '", n, "' is None; the store has no null")).when(found != want, say("field '", n, "' must be ", want, ", got ", found))

    missing = F.filter(names, lambda n: ~F.map_contains_key(m, n))
    extra = F.array_except(F.map_keys(m), names)
    empty = F.transform(F.filter(F.array(*[F.lit(n) for n in REQUIRED]), lambda n: F.map_contains_key(m, n) & (F.coalesce(text(n), F.lit("")) == "")), lambda n: say("required field '", n, "' is empty"))
    present = F.filter(names, lambda n: F.map_contains_key(m, n))
    start, end, relation = number("page_start"), number("page_end"), of("standard_relation")
    std, ver = F.coalesce(of("standard_id"), F.lit("")), F.coalesce(of("version_id"), F.lit(""))
    identity, other = relation == "identity", relation.isin("none", "reference")
    last = [
        F.when(start < 1, say("page_start ", start, " is not a valid page number")),
        F.when(end < 1, say("page_end ", end, " is not a valid page number")),
        F.when(end < start, say("inverted page range: page_start=", start, " > page_end=", end)),
        F.when(identity & (std == ""), "standard_relation='identity' but standard_id is empty"),
        F.when(identity & (ver == ""), "standard_relation='identity' but version_id is empty"),
        F.when(other & (std != ""), say("standard_relation='", relation, "' must not carry standard_id '", std, "'")),
        F.when(other & (ver != ""), say("standard_relation='", relation, "' must not carry version_id '", ver, "'")),
        F.when(~relation.isin(*RELATIONS), say("unknown standard_relation '", relation, "'")),
        F.when((ver != "") & (std == ""), "version_id present without standard_id"),
        F.when((std != "") & (ver != "") & ~F.startswith(ver, say("ver_", std, "_")), say("version_id '", ver, "' does not belong to standard_id '", std, "'")),
    ]
    version = of("schema_version")
    first = [F.when(F.size(missing) > 0, say("missing fields: ", _listed(missing))), F.when(F.size(extra) > 0, say("unexpected fields: ", _listed(extra)))]
    return F.array_compact(F.concat(F.array(*first), empty, F.array(F.when(version != VERSION, say("schema_version '", version, f"' != current '{VERSION}'"))), F.transform(present, of_type), F.array(*last)))
