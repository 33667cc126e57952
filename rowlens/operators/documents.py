"""Rows as text documents with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowlens.functions.names import display_label
from rowlens.functions.text import strip, text_of
from rowlens.operators.identity import ROW_ID, add_row_ids


def row_text(df: DataFrame) -> Column:
    """``Label: value`` for every non-blank cell, joined by `` | ``, in column order."""
    parts = []
    for name in df.columns:
        if name == ROW_ID:
            continue
        part = F.concat(F.lit(display_label(name) + ": "), text_of(df, name))
        if isinstance(df.schema[name].dataType, T.StringType):
            part = F.when(strip(F.col(f"`{name}`")) != "", part)
        parts.append(part)
    return F.concat_ws(" | ", *parts)


def row_metadata(df: DataFrame) -> Column:
    """The row as a JSON object: numbers and booleans kept, the rest text, nulls left out."""
    members = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif not isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            c = text_of(df, field.name)
        members.append(c.alias(field.name))
    return F.to_json(F.struct(*members))


# Types that a VARIANT holds as they are.
_TYPED = (
    T.NumericType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType
)


def row_variant(df: DataFrame) -> Column:
    """The row as a VARIANT object: values keep their types, nested ones are text; nulls and NaN are null."""
    members = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif not isinstance(field.dataType, _TYPED):
            c = text_of(df, field.name)
        members.append(c.alias(field.name))
    return F.to_variant_object(F.struct(*members))


def metadata_field(df: DataFrame, name: str, kind: str = "string", metadata: str = "metadata") -> Column:
    """One field of the metadata, JSON text or VARIANT, as ``kind``; null where it is missing or does not fit."""
    if "'" in name and '"' in name:
        raise ValueError(f"a field name with both kinds of quotes cannot be addressed: {name}")
    data = F.col(f"`{metadata}`")
    if isinstance(df.schema[metadata].dataType, T.StringType):
        data = F.try_parse_json(data)
    mark = '"' if "'" in name else "'"
    return F.try_variant_get(data, f"$[{mark}{name}{mark}]", kind)


def to_documents(df: DataFrame, typed: bool = False) -> DataFrame:
    """``row_id, text, metadata`` of every row; ids are added where missing. ``typed`` metadata is a VARIANT."""
    df = df if ROW_ID in df.columns else add_row_ids(df)
    return df.select(
        F.col(ROW_ID), row_text(df).alias("text"), (row_variant if typed else row_metadata)(df).alias("metadata")
    )


def drop_blank(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.filter(strip(F.col(text)) != "")
