"""Stable hashes of values, and ids made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, all else as it is."""
    out = F.regexp_replace(text, r'(["\\])', r"\\$1")
    for char, name in (("\n", "n"), ("\r", "r"), ("\t", "t"), ("\b", "b"), ("\f", "f")):
        out = F.replace(out, F.lit(char), F.lit("\\" + name))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """Compact JSON with sorted keys; each field is (column, kind), kind one of string, number, bool."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        value, kind = fields[name]
        text = json_string(value) if kind == "string" else value.cast("string")
        parts += [F.lit(("," if k else "") + f'"{name}":'), F.coalesce(text, F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def stable_hash(fields: dict[str, tuple[Column, str]]) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(fields), 256)


def deterministic_id(namespace: str, digest: Column, length: int = 16) -> Column:
    return F.concat(F.lit(f"{namespace}-"), F.substring(digest, 1, length))
