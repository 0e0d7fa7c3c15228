"""Reading open JSON held in VARIANT columns, with wrong types counting as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return "$." + key if key.replace("_", "a").isalnum() else f"$['{key}']"


def parse(raw: Column) -> Column:
    return F.try_parse_json(raw)


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, _path(key), "variant")


def kind(v: Column) -> Column:
    """Type name of a variant: VOID for JSON null, NULL where there is nothing."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT<"), F.lit(False))


def text(v: Column, key: str) -> Column:
    """A member that is a string, else NULL."""
    m = member(v, key)
    return F.when(kind(m) == "STRING", F.try_variant_get(v, _path(key), "string"))


def first_text(v: Column, keys: list[str], strip: bool = True) -> Column:
    """The first member that is a string with more than white space, else ''."""
    found = F.coalesce(*(F.when(filled(text(v, k)), text(v, k)) for k in keys), F.lit(""))
    return trimmed(found) if strip else found


def filled(c: Column) -> Column:
    """True for text with more than white space. It reads no further than the first such character."""
    return c.rlike(r"(?U)\S")


def trimmed(c: Column) -> Column:
    """Strips white space of all kinds, not only blanks."""
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+\z", "")


def has(v: Column, key: str) -> Column:
    return kind(member(v, key)).isNotNull()


def python_str(v: Column, key: str, missing: str) -> Column:
    """str() of a member as Python prints it; `missing` where the key is absent."""
    m, t = member(v, key), F.try_variant_get(v, _path(key), "string")
    k = kind(m)
    number = F.when(k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"), F.when(t.rlike(r"[.eE]"), t).otherwise(F.concat(t, F.lit(".0"))))
    return F.when(k.isNull(), F.lit(missing)).when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(t)).when(number.isNotNull(), number).otherwise(t)


def members(v: Column, key: str) -> Column:
    """array<variant> of a list member; an empty array for anything else."""
    m = member(v, key)
    return F.coalesce(F.when(kind(m).startswith("ARRAY<"), F.try_variant_get(v, _path(key), "array<variant>")), F.array().cast("array<variant>"))
