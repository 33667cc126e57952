"""Text of values, as JVM column expressions (no Python at run time)."""

from __future__ import annotations

import json
from collections.abc import Container, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Every character that counts as white space in text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

_LETTERED_ESCAPES = ("0b", "0e", "0f", "1a", "1b", "1c", "1d", "1e", "1f")


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends.

    A trim builds a table of all characters, so it is made only where an end
    character asks for it.
    """
    blanks = F.lit(WHITESPACE)
    padded = F.contains(blanks, F.substring(c, 1, 1)) | F.contains(blanks, F.substring(c, -1, 1))
    return F.when(padded, F.btrim(c, blanks)).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def _rarely(c: Column, expression) -> Column:
    """``expression(c)`` kept out of line, for branches few rows take.

    Inlined for every column, such branches make one generated method too long
    for the JVM to compile, and all rows pay for it.
    """
    return F.get(F.transform(F.array(c), expression), F.lit(0))


def _unusual_number(c: Column) -> Column:
    raw = c.cast("string")
    # Some JVMs print a 17th or 18th digit that the value does not need.
    exact = raw
    for form in ("%.16e", "%.15e"):
        shorter = F.upper(F.format_string(form, c.cast("double")))
        exact = F.when(shorter.try_cast("double") == c, shorter).otherwise(exact)
    plain = F.regexp_replace(
        exact.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1"
    )
    scientific = F.regexp_replace(exact, r"\.?0*E\+?", "E")
    scientific = F.regexp_replace(scientific, r"E(\d)", "e+$1")
    scientific = F.regexp_replace(scientific, "E-", "e-")
    scientific = F.regexp_replace(scientific, r"(e[+-])(\d)$", "$10$2")
    return (
        F.when(F.isnan(c), F.lit(None).cast("string"))
        .when(raw == "Infinity", "inf")
        .when(raw == "-Infinity", "-inf")
        .when((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16), plain)
        .otherwise(scientific)
    )


def _number_text(c: Column) -> Column:
    """Decimal text of a float: plain from 1e-4 up to 1e16, else ``1e-05`` style."""
    raw = c.cast("string")
    usual = (F.length(raw) < 18) & (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) | (c == 0)
    return F.when(usual, raw).otherwise(_rarely(c, _unusual_number))


def _utc(c: Column) -> Column:
    """An instant as the wall clock of UTC, whatever the zone of the session."""
    seconds = (F.unix_micros(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def as_text(c: Column, kind: T.DataType) -> Column:
    """One fixed text per value, whatever the source; null (and NaN) stay null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return _number_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        plain = (_utc(c) if isinstance(kind, T.TimestampType) else c).cast("string")
        return F.when(plain.contains("."), F.rpad(plain, 26, "0")).otherwise(plain)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    """:func:`as_text` of a column of ``df``."""
    return as_text(F.col(f"`{name}`"), df.schema[name].dataType)


def json_object(members: Mapping[str, Column], safe: Container[str] = ()) -> Column:
    """JSON object of text columns in the given order, nulls kept, ``", "`` and ``": "`` between parts.

    Values are named several times over, so they should be columns rather than
    expressions. Rows in need of escapes take the JSON writer; a quote inside
    its values follows a backslash, so ``,"name":`` is found between members only.
    Members in ``safe`` (numbers and the like) never need escapes.
    """
    if not members:
        return F.lit("{}")
    keys = [json.dumps(name, ensure_ascii=False) for name in members]
    plain = F.concat_ws(
        ", ",
        *[
            F.concat(F.lit(f"{key}: "), F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null")))
            for key, c in zip(keys, members.values())
        ],
    )
    fields = F.struct(*[c.alias(name) for name, c in members.items()])
    escaped = F.to_json(fields, {"ignoreNullFields": "false"})
    for i, key in enumerate(keys):
        before, after = ("{", "{") if i == 0 else (",", ", ")
        escaped = F.replace(escaped, F.lit(f"{before}{key}:"), F.lit(f"{after}{key}: "))
    plain = F.concat(F.lit("{"), plain, F.lit("}"))
    checked = [c for name, c in members.items() if name not in safe]
    if not checked:
        return plain
    return F.when(F.concat_ws("", *checked).rlike(r'["\\\x00-\x1F]'), escaped).otherwise(plain)


def lower_escapes(text: Column) -> Column:
    """JSON with its control escapes in lower case; ``text`` should be a column."""
    lowered = text
    for code in _LETTERED_ESCAPES:
        lowered = F.regexp_replace(
            lowered, rf"(?<!\\)((?:\\\\)*)\\u00{code.upper()}", rf"$1\\u00{code}"
        )
    return F.when(text.contains(r"\u00"), lowered).otherwise(text)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")
