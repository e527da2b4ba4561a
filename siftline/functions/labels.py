"""Label parsing and resolution (N1, N2) on JSON text, without a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_labels(labels: Column) -> Column:
    """Labels text as a variant object; missing or broken text gives ``{}``."""
    parsed = F.try_parse_json(F.when(F.trim(labels) != "", labels))
    return F.coalesce(parsed, F.parse_json(F.lit("{}")))


def _binary(value: Column) -> Column:
    """1/0 for JSON true/false/1/0 (also 1.0/0.0), null for anything else."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int")).when(
        is_number & number.isin(0.0, 1.0), number.cast("int")
    )


def label_field(labels: Column) -> Column:
    """``is_relevant`` inside the labels object as a variant, null when absent."""
    return F.try_variant_get(F.try_parse_json(labels), "$.is_relevant", "variant")


def is_labeled(labels: Column) -> Column:
    """Stored labels that count as present."""
    return labels.isNotNull() & ~labels.isin("{}", "")


def is_relevant_json(labels: Column) -> Column:
    """JSON ``is_relevant`` equal to 1 (true, 1 or 1.0; never the string)."""
    return F.coalesce(_binary(label_field(labels)) == 1, F.lit(False))


def flag_or_minus_one(labels: Column) -> Column:
    """Integer flag for the labelled export: -1 when there is none."""
    value = label_field(labels)
    kind = F.schema_of_variant(value)
    as_int = F.when(
        kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int")
    ).otherwise(F.try_variant_get(value, "$", "double").cast("int"))
    return F.coalesce(as_int, F.lit(-1))


def resolve_label(df: DataFrame, direct: str | None = None, label_col: str = "label") -> DataFrame:
    """Add a 0/1 label and drop rows without content or without a valid label.

    ``direct`` names a column holding a top-level ``is_relevant`` as JSON text.
    Where that text is not null it decides alone, even when it is invalid.
    """
    nested = _binary(label_field(F.col("labels")))
    label = nested
    if direct is not None:
        top = _binary(F.try_parse_json(F.col(direct)))
        label = F.when(F.col(direct).isNotNull(), top).otherwise(nested)
    has_content = F.col("content").isNotNull() & (F.col("content") != "")
    return df.filter(has_content).withColumn(label_col, label).filter(F.col(label_col).isNotNull())
