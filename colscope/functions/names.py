"""Features of field and table names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the name features.
NAME_FEATURES = [
    "field_name_length", "x_in_name", "y_in_name", "id_in_name", "time_in_name",
    "digit_in_name", "dollar_in_name", "pound_in_name", "euro_in_name", "yen_in_name",
    "first_char_uppercase_name", "num_uppercase_characters", "space_in_name",
    "number_of_words_in_name",
]


def name_features(name: Column) -> dict[str, Column]:
    n = F.when(name == "", " ").otherwise(name)
    first = F.substring(n, 1, 1)

    def edge(token: str) -> Column:
        return n.startswith(token) | n.endswith(token)

    values = [
        F.length(n), edge("x"), edge("y"), edge("id"), n.contains("time"),
        n.rlike(r"\d"), n.contains("$"), n.contains("£"), n.contains("€"), n.contains("¥"),
        first == F.upper(first), F.length(F.regexp_replace(n, r"[^\p{Lu}]", "")),
        n.contains(" "), F.size(F.split(n, " ")),
    ]
    return dict(zip(NAME_FEATURES, values))


def source_field_id(src: Column) -> Column:
    """First and last part of ``user:dataset:uid``."""
    parts = F.split(src, ":")
    return F.concat_ws(":", F.element_at(parts, 1), F.element_at(parts, -1))


def owner(fid: Column) -> Column:
    return F.element_at(F.split(fid, ":"), 1)


def field_id(fid: Column, uid: Column) -> Column:
    return F.concat_ws(":", owner(fid), uid)


def bare_table_name(name: Column) -> Column:
    """Lower case, without a ``.csv`` ending."""
    return F.regexp_replace(F.lower(name), r"\.csv$", "")


def unique_names(header: Column) -> Column:
    """Column names as pandas reads them: a repeated ``a`` is ``a.1``, a blank one ``Unnamed: 0`` by its place."""
    named = F.transform(header, lambda h, i: F.coalesce(h, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    none = F.array().cast("array<string>")

    def add(taken: Column, name: Column) -> Column:
        fresh = F.filter(F.transform(F.sequence(F.lit(1), F.size(named) + F.lit(1)), lambda k: F.concat(name, F.lit("."), k.cast("string"))),
                         lambda c: ~F.array_contains(taken, c) & ~F.array_contains(named, c))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, name), F.get(fresh, F.lit(0))).otherwise(name)))

    return F.aggregate(named, none, add)
