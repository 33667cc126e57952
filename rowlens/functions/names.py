"""Column names. Names are metadata, so all of this runs once, at plan time."""

from __future__ import annotations

import re
from collections.abc import Collection, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowlens.functions.text import as_text

# Header spellings and the column each stands for. The lookup is
# made once per name, so date_of_publication becomes publication_date.
COLUMN_ALIASES = {
    "title_of_publicaion": "title",
    "title_of_publication": "title",
    "dept.": "dept",
    "department": "dept",
    "date_of_publication": "publication_date",
    "pub_date": "publication_date",
    "author_name": "author",
    "authors": "author",
    "publication_type": "pub_type",
    "type": "pub_type",
}


def clean_name(header: str, aliases: Mapping[str, str] = COLUMN_ALIASES) -> str:
    """Lower-case, blanks to one underscore, no trailing underscore, then the alias."""
    name = "_".join(str(header).lower().split()).rstrip("_")
    return aliases.get(name, name)


def display_label(name: str) -> str:
    """``pub_type`` -> ``Pub Type``."""
    return name.replace("_", " ").title()


def clean_columns(
    df: DataFrame,
    aliases: Mapping[str, str] = COLUMN_ALIASES,
    on_collision: str = "coalesce",
) -> DataFrame:
    """Rename every column with :func:`clean_name`.

    Headers that meet in one name are coalesced left to right, or refused with
    ``on_collision="error"``.
    """
    names = [clean_name(c, aliases) for c in df.columns]
    if len(set(names)) == len(names):
        return df.toDF(*names)
    if on_collision == "error":
        clashes = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"headers meet in one column name: {clashes}")

    positions: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        positions.setdefault(name, []).append(i)
    by_position = df.toDF(*[f"_{i}" for i in range(len(names))])
    fields = by_position.schema.fields

    def merged(group: list[int]):
        types = {fields[i].dataType for i in group}
        if len(types) == 1:
            return F.coalesce(*[F.col(f"_{i}") for i in group])
        return F.coalesce(*[as_text(F.col(f"_{i}"), fields[i].dataType) for i in group])

    return by_position.select([merged(group).alias(name) for name, group in positions.items()])


_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
_DECIMAL = re.compile(r"decimal\((\d+),(\d+)\)")


def common_type(kinds: Collection[str]) -> str:
    """The type that holds every value of these types apart from every other one; text where no number does."""
    kinds = set(kinds) - {"void"} or set(kinds)
    if len(kinds) == 1:
        return next(iter(kinds))
    if kinds <= _DIGITS.keys():
        return max(kinds, key=_DIGITS.get)
    if kinds <= {"tinyint", "smallint", "int", "float", "double"}:
        return "double"  # not with bigint: neighbours beyond 2**53 would become one value
    shapes = [(int(m[1]) - int(m[2]), int(m[2])) for k in kinds if (m := _DECIMAL.fullmatch(k))]
    shapes += [(_DIGITS[k], 0) for k in kinds if k in _DIGITS]
    whole, places = max((w for w, _ in shapes), default=0), max((p for _, p in shapes), default=0)
    if len(shapes) == len(kinds) and whole + places <= 38:
        return f"decimal({whole + places},{places})"
    return "string"


def align_types(frames: list[DataFrame]) -> list[DataFrame]:
    """Give a column one type in all frames: the wider number, else text.

    A plain union would cast text to numbers under ANSI rules and fail on the
    first word.
    """
    seen: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            seen.setdefault(name, set()).add(kind)
    target = {name: common_type(kinds) for name, kinds in seen.items()}

    def cast_to(df: DataFrame) -> DataFrame:
        if all(target[name] == kind for name, kind in df.dtypes):
            return df
        out = []
        for field in df.schema.fields:
            c, want = F.col(f"`{field.name}`"), target[field.name]
            if field.dataType.simpleString() == want:
                out.append(c)
            elif want == "string":
                out.append(as_text(c, field.dataType).alias(field.name))
            else:
                out.append(c.cast(want).alias(field.name))
        return df.select(out)

    return [cast_to(df) for df in frames]


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns are null, order is first seen."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), align_types(frames)
    )
