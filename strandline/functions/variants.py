"""Types of JSON fields before they are cast, through VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_type(value: Column, path: str) -> Column:
    """string, number, boolean, array, object or null; missing if there is no such field, invalid if the text is no JSON."""
    parsed = F.try_parse_json(value)
    found = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    kind = (F.when(found == "VOID", F.lit("null")).when(found == "STRING", F.lit("string")).when(found == "BOOLEAN", F.lit("boolean"))
            .when(found.startswith("ARRAY"), F.lit("array")).when(found.startswith("OBJECT"), F.lit("object")).otherwise(F.lit("number")))
    return F.when(parsed.isNull(), F.lit("invalid")).when(found.isNull(), F.lit("missing")).otherwise(kind)


def wrong_types(df: DataFrame, value: str, expected: dict[str, tuple[str, ...]]) -> DataFrame:
    """(field, found, rows): how often a field has a type that ``expected`` (field -> types) does not name.  One pass, one aggregate.

    Fields are top-level names.  A null text counts as invalid.
    """
    each = F.array(*[F.struct(F.lit(name).alias("field"), field_type(F.col(value), f"$.{name}").alias("found"), F.lit(list(kinds)).alias("kinds")) for name, kinds in expected.items()])
    long = df.select(F.inline(each)).where(~F.array_contains("kinds", F.col("found")))
    return long.groupBy("field", "found").agg(F.count("*").alias("rows"))


def merged_schema(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One schema that holds all JSON texts of each batch (``by`` columns), as text: what changed between batches is drift."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(F.try_parse_json(F.col(value))).alias("schema"))
