"""Typed attribute values: construction, extraction and canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING, BOOLEAN, INTEGER, FLOAT, STRING_LIST = (
    "string",
    "boolean",
    "integer",
    "float",
    "string_list",
)


def _value(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


def string_value(col: Column) -> Column:
    return _value(STRING, col.cast("string"))


def integer_value(col: Column) -> Column:
    return _value(INTEGER, col.cast("bigint").cast("string"))


def boolean_value(col: Column) -> Column:
    return _value(BOOLEAN, col.cast("boolean").cast("string"))


def float_value(col: Column) -> Column:
    return _value(FLOAT, float_text(col))


def list_value(col: Column) -> Column:
    return _value(STRING_LIST, F.to_json(col))


def attribute_map(**values: Column) -> Column:
    """MAP of name to VALUE; a null VALUE text means the attribute is absent."""
    pairs = [F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in sorted(values.items())]
    present = F.filter(F.array(*pairs), lambda p: p["value"]["text"].isNotNull())
    return F.map_from_entries(present)


def attr_text(attrs: Column, name: str) -> Column:
    """The value's text, whatever its kind; null when absent."""
    return attrs[name]["text"]


def attr_string(attrs: Column, name: str) -> Column:
    """The text of a string attribute; null when absent or of another kind."""
    return F.when(attrs[name]["kind"] == STRING, attrs[name]["text"])


def attr_list_empty(attrs: Column, name: str) -> Column:
    """True when the attribute is absent or an empty list / empty string."""
    text = attr_text(attrs, name)
    return text.isNull() | text.isin("", "[]")


def float_text(col: Column) -> Column:
    """Shortest round-trip spelling with at least one decimal, exponent as ``e-05``/``e+16``.

    Spark spells 1e16 as ``1.0E16`` and 1e-4 as ``1.0E-4``; the canonical form is
    positional for exponents -4..15 and two-digit exponential elsewhere. Negative
    zero folds to zero; non-finite values have no spelling and become null.
    """
    number = col.cast("double") + F.lit(0.0)
    number = F.when(number == 0.0, F.lit(0.0)).otherwise(number)
    text = number.cast("string")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    short = F.regexp_replace(mantissa, r"\.0$", "")
    positional = F.when(
        exponent >= 0,
        F.concat(
            F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")),
            F.lit("."),
            F.when(
                F.length(digits) > exponent + 1,
                F.substring(digits, exponent + 2, F.lit(400)),
            ).otherwise(F.lit("0")),
        ),
    ).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
    scientific = F.concat(
        short,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    scientific = F.when(
        F.abs(exponent) >= 100,
        F.concat(
            short,
            F.lit("e"),
            F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
            F.abs(exponent).cast("string"),
        ),
    ).otherwise(scientific)
    spelled = F.when(exponent.isNull(), text).otherwise(
        F.concat(sign, F.when((exponent >= -4) & (exponent < 16), positional).otherwise(scientific))
    )
    return F.when(F.isnan(number) | F.abs(number).isin(float("inf")), F.lit(None)).otherwise(spelled)


def variant_kind(variant: Column) -> Column:
    """The attribute kind of a JSON value; null for null, objects and mixed arrays."""
    shape = F.schema_of_variant(variant)
    return (
        F.when(shape == "STRING", F.lit(STRING))
        .when(shape == "BOOLEAN", F.lit(BOOLEAN))
        # integers past the long range arrive as wide scale-0 decimals
        .when((shape == "BIGINT") | shape.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), F.lit(INTEGER))
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), F.lit(FLOAT))
        .when(shape.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(STRING_LIST))
    )


def variant_value(variant: Column) -> Column:
    """A JSON value as VALUE, or null when its shape is not representable."""
    kind = variant_kind(variant)
    empty_list = F.schema_of_variant(variant) == "ARRAY<VOID>"
    # ARRAY<VOID> covers [] and [null, ...]; only the former is a list of strings
    items = F.try_variant_get(variant, "$", "array<string>")
    text = (
        F.when(kind == FLOAT, float_text(F.try_variant_get(variant, "$", "double")))
        .when(empty_list, F.when(F.try_variant_get(variant, "$", "string") == "[]", F.lit("[]")))
        .when(kind == STRING_LIST, F.when(F.forall(items, lambda i: i.isNotNull()), F.to_json(items)))
        .otherwise(F.try_variant_get(variant, "$", "string"))
    )
    return F.when(kind.isNotNull() & text.isNotNull(), F.struct(kind.alias("kind"), text.alias("text")))
