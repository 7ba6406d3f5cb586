"""Identity and hash formulas as Column expressions; all give lower-case hex of SHA-256 over UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_space, trim_space


def _json(*parts: Column) -> Column:
    """A JSON array that keeps nulls as null."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def claim_hash(epistemic_type: Column, text: Column) -> Column:
    """Type, line feed, and the text trimmed with its white space collapsed."""
    return sha256(F.concat(epistemic_type, F.lit("\n"), collapse_space(trim_space(text))))


def pin_hash(title: Column, body: Column, ref: Column) -> Column:
    """Snapshot of a passage: a null title or ref differs from an empty one."""
    return sha256(_json(title, body, ref))


def passage_id(kind: Column, root: Column, ref: Column) -> Column:
    return F.concat(F.lit("vdoc_"), F.substring(sha256(_json(kind, root, ref)), 1, 16))


def passage_ref(path: Column, ordinal: Column) -> Column:
    return F.concat(path, F.lit("#p"), ordinal.cast("string"))


def passage_path(ref: Column) -> Column:
    """Only a trailing #p and digits go."""
    return F.regexp_replace(ref, r"#p\d+$", "")


def code_chunk_hash(path: Column, start: Column, end: Column, body: Column) -> Column:
    return sha256(F.concat(path, F.lit(":"), start.cast("string"), F.lit(":"), end.cast("string"), F.lit("\n"), body))


def code_doc_id(chunk_hash: Column) -> Column:
    return F.concat(F.lit("code_"), F.substring(chunk_hash, 1, 24))


def symbol_doc_id(symbol: Column) -> Column:
    return F.concat(F.lit("scip_"), F.substring(sha256(symbol), 1, 20))


def legacy_snapshot(*parts: Column) -> Column:
    """Parts joined by line feeds, nulls as empty; the last part, the body, is trimmed."""
    *head, body = [F.coalesce(p, F.lit("")) for p in parts]
    return sha256(F.concat_ws("\n", *head, trim_space(body)))


def canonical_json(c: Column) -> Column:
    """JSON text with the keys of all objects in order and without spaces; null where it isn't JSON.

    A VARIANT keeps an object's fields sorted by their names at every depth, so parsing and writing it is all there is to do.
    """
    return F.to_json(F.try_parse_json(c))


def chain_hash(prev: Column, payload: Column) -> Column:
    return sha256(F.concat(prev, F.lit("\n"), payload))


def merkle_parent(left: Column, right: Column) -> Column:
    """Over the hex text of both children."""
    return sha256(F.concat(left, right))


def checkpoint_link(prev_root: Column, root: Column) -> Column:
    return sha256(F.concat(F.coalesce(prev_root, F.lit("GENESIS")), F.lit("\n"), root))


def tool_schema_hash(name: Column, description: Column, schema_json: Column) -> Column:
    """Name, description and input schema; the schema is JSON text and goes in canonically, as it is where it can't be parsed."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    return sha256(F.concat(F.lit('{"name":'), text(name), F.lit(',"description":'), text(description), F.lit(',"inputSchema":'), F.coalesce(canonical_json(schema_json), schema_json, F.lit("null")), F.lit("}")))
