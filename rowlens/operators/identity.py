"""Content-hash row ids and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowlens.functions.text import json_object, lower_escapes, strip, text_of

ROW_ID = "row_id"
_NO_ESCAPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _hash_text(df: DataFrame, name: str) -> Column:
    text = text_of(df, name)
    return strip(text) if isinstance(df.schema[name].dataType, T.StringType) else text


def _free(taken: set[str], stem: str) -> str:
    """``stem``, with underscores in front until no column has the name."""
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def add_row_ids(
    df: DataFrame,
    id_columns: Sequence[str] | None = None,
    type_column: str = "pub_type",
    length: int | None = None,
) -> DataFrame:
    """Add ``row_id``; where the column exists, fill only its nulls.

    The id is the SHA-256 of the row as JSON with sorted keys, then ``|`` and
    the type. It covers ``id_columns`` (default: every column but ``row_id``).
    ``length`` cuts it to a prefix; the id is what duplicates are told by, and a
    prefix of 16 characters is expected to collide within some 10^9 rows.
    The texts, the JSON and the hash are three projections, so that none of them
    is computed for each place it is used in.
    """
    names = sorted(set(id_columns or df.columns) - {ROW_ID})
    taken = {c.lower() for c in df.columns}
    stem, json_name = _free(taken, "id_text"), _free(taken, "id_json")
    while any(f"{stem}{i}" in taken for i in range(len(names))):
        stem = f"_{stem}"
    text = {name: f"{stem}{i}" for i, name in enumerate(names)}
    staged = df.select("*", *[_hash_text(df, name).alias(text[name]) for name in names])
    safe = {f.name for f in df.schema.fields if isinstance(f.dataType, _NO_ESCAPES)}
    staged = staged.withColumn(json_name, json_object({name: F.col(text[name]) for name in names}, safe))
    kind = F.lit("")
    if type_column in names:
        kind = F.coalesce(F.col(text[type_column]), F.lit("None"))
    computed = F.sha2(F.concat(lower_escapes(F.col(json_name)), F.lit("|"), kind), 256)
    if length is not None:
        computed = F.substring(computed, 1, length)
    if ROW_ID in df.columns:
        computed = F.coalesce(F.col(ROW_ID), computed)
    kept = [F.col(f"`{c}`") for c in df.columns if c != ROW_ID]
    return staged.select(*kept, computed.alias(ROW_ID))


def dedup_rows(
    df: DataFrame, key: str = ROW_ID, order_by: Sequence[str] | None = None
) -> DataFrame:
    """Keep one row per key: the first in ``order_by``, then in the other columns.

    An aggregate, not a window: copies collapse in the map tasks, so a key that
    holds a third of the rows sends one row per task through the shuffle. The
    row is its own order, so it is carried once; where a column holds maps, which
    have no order, the row is ordered by their JSON instead.
    """
    first = [c for c in (order_by or df.columns)]
    rest = [c for c in df.columns if c not in first]
    fields = {c: f"f{i}" for i, c in enumerate([*first, *rest])}
    row = F.struct(*[F.col(f"`{c}`").alias(f) for c, f in fields.items()])
    maps = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}
    if maps:
        cells = [F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in fields]
        chosen = F.min_by(row, F.struct(*[c.alias(f) for c, f in zip(cells, fields.values())]))
    else:
        chosen = F.min(row)
    kept = df.groupBy(F.col(f"`{key}`").alias("_key")).agg(chosen.alias("kept"))
    return kept.select(*[F.col(f"kept.{fields[c]}").alias(c) for c in df.columns])
