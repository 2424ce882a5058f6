"""Type votes and parsing of raw cell text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vote weights, order of precedence, and the general class of each type.
TYPE_WEIGHTS = {"string": 1, "integer": 4, "decimal": 3, "time": 2}
TYPE_ORDER = ["string", "integer", "decimal", "time"]
GENERAL_TYPE = {"string": "c", "integer": "q", "decimal": "q", "time": "t"}

# The accepted spellings.
INTEGER_PATTERN = r"^(0|-?[1-9]\d*)$"
DECIMAL_PATTERN = (r"(?i)^\s*[+-]?(((\d[\d_]*(\.[\d_]*)?)|(\.\d[\d_]*))(e[+-]?\d[\d_]*)?"
                   r"|inf|infinity|s?nan\d*)\s*$")
DATE_PREFIX_PATTERN = r"^\d{1,4}[-/.\s]\S+[-/.\s]\S+"


def is_integer_text(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN)


def is_decimal_text(c: Column) -> Column:
    return c.rlike(DECIMAL_PATTERN)


def is_time_text(c: Column) -> Column:
    return c.rlike(DATE_PREFIX_PATTERN)


def vote_columns(raw: Column, weight: Column) -> dict[str, Column]:
    """Aggregates giving the score of every type; empty and null cells do not vote."""
    votes = raw.isNotNull() & (raw != "")
    tests = {"string": F.lit(True), "integer": is_integer_text(raw),
             "decimal": is_decimal_text(raw), "time": is_time_text(raw)}
    out = {}
    for name in TYPE_ORDER:
        score = F.sum(F.when(votes & tests[name], weight * TYPE_WEIGHTS[name]).otherwise(F.lit(0)))
        base = 1 if name == "string" else 0
        out[name] = (score + base).cast("bigint")
    return out


def winning_type(scores: dict[str, Column]) -> Column:
    """Highest score; a tie goes to the type listed first."""
    best = F.greatest(*[scores[n] for n in TYPE_ORDER])
    chain = None
    for name in TYPE_ORDER:
        hit = scores[name] == best
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def general_type(data_type: Column) -> Column:
    chain = None
    for name, general in GENERAL_TYPE.items():
        hit = data_type == name
        chain = F.when(hit, general) if chain is None else chain.when(hit, general)
    return chain


def parse_integer(raw: Column) -> Column:
    """Whole numbers only; anything else is NULL."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^[+-]?\d+(_\d+)*$"),
                  F.regexp_replace(text, "_", "").try_cast("double"))


def parse_decimal(raw: Column) -> Column:
    """Finite numbers only; anything else is NULL."""
    text = F.regexp_replace(F.trim(raw), r"(?<=\d)_(?=\d)", "")
    value = F.when(text.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"),
                   text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


# The date shapes tried when parsing, day first.
DAY_FIRST_DATES = ["dd/MM/yyyy", "dd/MM/yy", "yyyy/MM/dd", "dd/MMM/yyyy", "dd/MMMM/yyyy"]
MONTH_FIRST_DATES = ["MM/dd/yyyy", "MM/dd/yy", "yyyy/MM/dd", "dd/MMM/yyyy", "dd/MMMM/yyyy"]
SEPARATORS = ["-", ".", "/", " "]
TIME_SHAPES = ["HH:mmz", "HH:mm:ss", "HH:mm:ssz"]
TIME_JOINERS = ["", "'T'", " "]


def date_formats(day_first: bool = True) -> list[str]:
    """Date x separator, alone and followed by every time shape."""
    dates = [d.replace("/", s) for s in SEPARATORS
             for d in (DAY_FIRST_DATES if day_first else MONTH_FIRST_DATES)]
    return dates + [d + j + t for d in dates for t in TIME_SHAPES for j in TIME_JOINERS]


# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december"]

CLOCK = r"(?:[T ]?(\d{1,2}:\d{2}(?::\d{2})?)\s*([A-Za-z]{1,5}|[+-]\d{2}:?\d{2})?)?"


def _month_number(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1)
                           for x in ([m, str(i)] if m == "may" else [m, str(i), m[:3], str(i)])])
    return F.try_element_at(table, F.lower(name))


def parse_timestamp(raw: Column, day_first: bool = True, formats: list[str] | None = None) -> Column:
    """ISO reading, else a date in one of four layouts with an optional clock, else NULL.

    The layouts cover every combination of ``date_formats``: one pattern per date
    order rewrites the text to ISO whatever the separator, instead of one parser
    run per format. Explicit ``formats`` are tried one by one.
    """
    text = F.trim(raw)
    if formats is not None:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    # The ISO cast would read a bare year or number as a date; ask for two separators.
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp"))
    day, month = ("$1", "$3") if day_first else ("$3", "$1")

    def rewrite(shape: str, iso_order: str) -> Column:
        pattern = f"^{shape}{CLOCK}$"
        iso_text = F.rtrim(F.regexp_replace(text, pattern, f"{iso_order} $5 $6"))
        return F.when(text.rlike(pattern), iso_text.try_cast("timestamp"))

    numeric = r"(\d{1,2})([-./ ])(\d{1,2})\2"
    long_year = rewrite(numeric + r"(\d{4})", f"$4-{month}-{day}")
    old = rewrite(numeric + r"(69|[789]\d)", f"19$4-{month}-{day}")
    recent = rewrite(numeric + r"(\d\d)", f"20$4-{month}-{day}")
    year_first = rewrite(r"(\d{4})([-./ ])(\d{1,2})\2(\d{1,2})", "$1-$3-$4")
    named_shape = r"^(\d{1,2})([-./ ])(\p{L}{3,9})\2(\d{4})" + CLOCK + "$"
    part = [F.regexp_extract(text, named_shape, i) for i in range(7)]
    named = F.when(text.rlike(named_shape), F.rtrim(F.concat_ws(
        "", part[4], F.lit("-"), _month_number(part[3]), F.lit("-"), part[1],
        F.lit(" "), part[5], F.lit(" "), part[6])).try_cast("timestamp"))
    return F.coalesce(iso, long_year, old, recent, year_first, named)


def parse_typed(raw: Column, data_type: Column) -> Column:
    """Orderable DOUBLE of a cell under its field type: numbers, or epoch seconds.

    Ambiguous dates read month first; the day comes first where only that works.
    """
    stamp = F.coalesce(parse_timestamp(raw, day_first=False), parse_timestamp(raw, day_first=True))
    return (F.when(data_type == "integer", parse_integer(raw))
            .when(data_type == "decimal", parse_decimal(raw))
            .when(data_type == "time", F.unix_micros(stamp) / 1e6))


def example_type(text: Column) -> Column:
    """Schema description of an example value: datetime, float, integer or string."""
    bare = F.trim(text)
    number = parse_decimal(text)
    # Years that fit a nanosecond clock, months and clock times read as dates too.
    year = bare.rlike(r"^\d{4}$") & number.between(1678, 2261)
    partial = bare.rlike(r"^(\d{4}-\d{1,2}|\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*([AaPp][Mm])?)$")
    worded = bare.rlike(r"^\p{L}{3,9} \d{1,2},? \d{4}") & _month_number(
        F.substring(F.regexp_extract(bare, r"^(\p{L}+)", 1), 1, 3)).isNotNull()
    stamp = parse_timestamp(text, False).isNotNull() | parse_timestamp(text, True).isNotNull()
    return (F.when(text.isNull(), "unknown")
            .when(year | partial | worded | stamp, "datetime")
            .when(number.isNotNull() & text.contains("."), "float")
            .when(number.isNotNull(), "integer")
            .otherwise("string"))
