"""JSON as text and as VARIANT.

Text rules and length checks are defined on the spaced JSON form (``", "`` and ``": "`` separators, source key
order, non-ASCII characters as ``\\uXXXX``). ``json_text`` produces that form from the compact text Spark yields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Either a whole string literal or a run of other characters, then a separator (or the end of the text).
_SEPARATORS = r'((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^",:"])*+)([,:]|$)'


def _escape_char(c: Column) -> Column:
    code = F.ascii(c)
    offset = code - 0x10000
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    return (
        F.when(code < 128, c)
        .when(code < 0x10000, unit(code))
        .otherwise(
            F.concat(
                unit(F.lit(0xD800) + F.shiftright(offset, 10)),
                unit(F.lit(0xDC00) + offset.bitwiseAND(0x3FF)),
            )
        )
    )


def ascii_escaped(text: Column) -> Column:
    """Replace non-ASCII characters by ``\\uXXXX``; rows without any are passed through untouched."""
    escaped = F.array_join(F.transform(F.split(text, ""), _escape_char), "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(text)


def json_text(compact: Column) -> Column:
    """Spaced JSON text of compact JSON text."""
    return ascii_escaped(F.rtrim(F.regexp_replace(compact, _SEPARATORS, "$1$2 ")))


def json_at(raw: Column, path: str) -> Column:
    """Compact JSON text of a nested value; keeps the key order of the source."""
    return F.get_json_object(raw, path)


def variant_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """JSON kind of a variant: VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """Tested by a one-level cast: the kind of an object describes everything inside it and is slow to build."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_integer(v: Column) -> Column:
    """JSON integers; booleans count, as they do wherever the semantics were defined."""
    return F.coalesce(kind(v).isin("BIGINT", "BOOLEAN"), F.lit(False))


def is_number(v: Column) -> Column:
    k = kind(v)
    return F.coalesce(k.isin("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.lit(False))


def is_present(v: Column) -> Column:
    """Present and not JSON null."""
    return F.coalesce(kind(v) != "VOID", F.lit(False))


def text_of(v: Column) -> Column:
    """A scalar as display text: ``None``, ``True``/``False``, else its own text. NULL stays NULL."""
    text = v.cast("string")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(text.isNull(), "None")
        .when(text.isin("true", "false") & ~is_string(v), F.initcap(text))
        .otherwise(text)
    )


def int_or_zero(v: Column, path: str) -> Column:
    """Whole-number reading of a field: fractions cut, numeric text read, everything else 0."""
    return F.coalesce(F.try_variant_get(v, path, "bigint"), F.lit(0).cast("bigint"))
