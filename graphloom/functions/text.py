"""String and number expressions over properties and names. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def prop(name: str, props: str = "props") -> Column:
    """A property, null when absent or empty."""
    return F.nullif(F.col(props)[name], F.lit(""))


def prop_int(name: str, props: str = "props") -> Column:
    """Integer property; missing or unreadable is 0."""
    return F.coalesce(F.expr(f"try_cast({props}['{name}'] AS INT)"), F.lit(0))


def prop_double(name: str, props: str = "props") -> Column:
    return F.expr(f"try_cast({props}['{name}'] AS DOUBLE)")


def fold_name(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def member_name(c: Column) -> Column:
    """The part after the last dot."""
    return F.substring_index(c, ".", -1)


def symbol_label(node_id: Column, kind: Column, name: Column) -> Column:
    """Methods as ``Type.method`` from the id, others by name."""
    tail = F.regexp_extract(node_id, r"#([^(]*)", 1)
    return F.when((kind == "method") & (tail != ""), tail).otherwise(name)


def is_camel_type(c: Column) -> Column:
    """At least two capitals and one small letter, letters and digits only."""
    return c.rlike("^[A-Za-z0-9]+$") & c.rlike("[A-Z].*[A-Z]") & c.rlike("[a-z]")


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"'`]|[\"'`]$", "")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def compact_type(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def estimate_chars(*parts: Column) -> Column:
    """Bytes of the parts and 48 of frame, as the budget counts a hit."""
    total = F.lit(48)
    for p in parts:
        total = total + F.coalesce(F.octet_length(p), F.lit(0))
    return total


def operation_folds(name: Column) -> Column:
    """Handler names an operation id may have: itself, Resolve.., Get.., and the part after an underscore."""
    folded = fold_name(name)
    after = fold_name(F.substring_index(name, "_", -1))
    return F.array_distinct(F.array(folded, F.concat(F.lit("resolve"), folded), F.concat(F.lit("get"), folded), after))


def verb_hint(name: Column) -> Column:
    """HTTP method that the last part of a wrapper's name starts or ends with, else ANY."""
    low = F.substring_index(F.lower(name), ".", -1)
    out = None
    for verb in ("delete", "patch", "post", "put", "get"):  # fixed values, in this order
        hit = low.rlike(f"^_*{verb}|{verb}$")
        out = F.when(hit, verb.upper()) if out is None else out.when(hit, verb.upper())
    return out.otherwise("ANY")
