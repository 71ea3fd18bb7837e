"""Strict JSON parsing to VARIANT, and canonical strings of JSON values.

Raw model output is untrusted: the engine's own parsers accept trailing text,
so a value counts only if it also parses inside an array and an object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.arrays import let
from caseframe.functions.text import normalize_string, strip

FENCE = "```"


def kind(v: Column) -> Column:
    """The JSON type of a VARIANT, as the engine names it; VOID is JSON null."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """By a cast that only objects pass; the type's name would spell out every level."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return items(v).isNotNull()


def is_string(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_none(v: Column) -> Column:
    """Missing or JSON null."""
    return F.coalesce(kind(v), F.lit("VOID")) == "VOID"


def _number_type(v: Column, k: Column) -> Column:
    large = k.rlike(r"^DECIMAL\((19|[23]\d),0\)$") & ~F.to_json(v).rlike("[.eE]")
    return F.when(k == "BIGINT", F.lit("int")).when(k == "BOOLEAN", F.lit("bool")).when(k.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when(large, F.lit("int")).otherwise(F.lit("float")))


def number_type(v: Column) -> Column:
    """``int``, ``float`` or ``bool`` of a JSON number or truth value, else null. A number with a point or exponent is a float."""
    return let(v, lambda x: let(kind(x), lambda k: _number_type(x, k)))


def get(v: Column, key: str) -> Column:
    """The member ``key``; null where it is missing or ``v`` is no object."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def items(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def string(v: Column) -> Column:
    """The text of a JSON string; null for anything else."""
    return let(v, lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def keys(v: Column) -> Column:
    """Sorted distinct keys of an object; null for anything else."""
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def canonical(v: Column, lower: bool = False) -> Column:
    """A string that two JSON values share if they are equal: 4 equals 4.0, true equals 1, a missing value equals null.

    With ``lower``, strings are compared stripped and in lower case.
    """

    def form(x: Column, k: Column) -> Column:
        text = F.try_variant_get(x, "$", "string")
        return (
            F.when(k.isNull() | (k == "VOID"), F.lit("n"))
            .when(k == "STRING", F.concat(F.lit("s"), normalize_string(text) if lower else text))
            .when(k.rlike("^(BIGINT|BOOLEAN|DECIMAL|DOUBLE|FLOAT)"), F.concat(F.lit("d"), F.try_variant_get(x, "$", "double").cast("string")))
            .otherwise(F.concat(F.lit("j"), F.to_json(x)))
        )

    return let(v, lambda x: let(kind(x), lambda k: form(x, k)))


def unfence(text: Column) -> Column:
    """Text inside Markdown fences: the first line goes, the last one if it is a fence too."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    closed = F.coalesce(strip(F.element_at(lines, -1)).startswith(FENCE), F.lit(False)) & (F.size(lines) > 1)
    body = F.when(closed, F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))).otherwise(body)
    return F.when(text.startswith(FENCE), strip(F.array_join(body, "\n"))).otherwise(text)


def strict_object(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON object, else null."""
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = let(items(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))), lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0))))
    return F.when(text.startswith("{") & text.endswith("}") & member.isNotNull(), let(alone, lambda x: F.when(is_object(x), x)))


def parse_object(text: Column, brace_fallback: bool = False) -> Column:
    """A prediction as VARIANT: stripped, unfenced, exactly one object; with the fallback also what the outermost braces hold."""
    def parse(body: Column) -> Column:
        found = strict_object(body)
        return F.coalesce(found, strict_object(F.regexp_extract(body, r"(?s)\{.*\}", 0))) if brace_fallback else found

    return let(strip(text), lambda t: let(unfence(t), parse))


def from_struct(c: Column) -> Column:
    """The VARIANT of a struct column, with its null fields."""
    return F.parse_json(F.to_json(c, {"ignoreNullFields": "false"}))
