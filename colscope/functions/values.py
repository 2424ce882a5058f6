"""Tolerant comparison of values, value lists and lists of lists.

Values are JSON texts (``1``, ``1.0``, ``Mon``; NULL for null). Variants:

``v1``  equal, or numbers closer than 0.01
``v2``  numbers cut to the shorter fraction and equal, whole parts when either
        is whole, weekday and month names match their numbers
``v3``  like ``v2``, with a tolerance of 0.01 after cutting
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .typing import MONTHS

TOLERANCE = 1e-2

# Names that stand for numbers.
WEEKDAYS = {"monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5, "saturday": 6, "sunday": 7,
            "mon": 1, "tue": 2, "wed": 3, "thu": 4, "fri": 5, "sat": 6, "sun": 7, "thur": 4}
MONTH_NUMBERS = {m: i for i, full in enumerate(MONTHS, 1) for m in (full, full[:3])}

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
_PLAIN = r"^[+-]?\d*\.\d+$"


def as_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _name_number(text: Column, names: dict[str, int], top: int) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    digits = F.when(text.rlike(r"^\s*\+?\d+\s*$"), F.trim(text).try_cast("int"))
    return F.coalesce(F.try_element_at(table, F.lower(text)), F.when(digits.between(1, top), digits))


def weekday_number(text: Column) -> Column:
    return _name_number(text, WEEKDAYS, 7)


def month_number(text: Column) -> Column:
    return _name_number(text, MONTH_NUMBERS, 12)


def _names() -> Column:
    """Weekday and month number of every name, in one map."""
    number = lambda names, name: F.lit(names.get(name)).cast("int")
    return F.create_map(*[x for name in {**WEEKDAYS, **MONTH_NUMBERS} for x in (
        F.lit(name), F.struct(number(WEEKDAYS, name).alias("day"), number(MONTH_NUMBERS, name).alias("month")))])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def describe(text: Column, variant: str = "v1", quoted: bool = False, inner: bool = False) -> Column:
    """Everything a comparison needs to know of one value, worked out once per value.

    ``quoted`` values are JSON texts: those in quotation marks are strings, which is
    remembered in ``mark``. ``inner`` is for use inside a lambda, where Spark works out an
    expression as often as it is named: each step is then bound to a name.
    """
    if variant not in ("v1", "v2", "v3"):
        raise ValueError("variant must be v1, v2 or v3")
    bind = _let if inner else lambda value, body: body(value)

    def shape(text: Column, mark: Column) -> Column:
        if variant == "v1":
            return F.struct(text.alias("text"), as_number(text).alias("num"), mark.alias("mark"))
        return bind(F.coalesce(text.rlike(_WHOLE), F.lit(False)), lambda whole: bind(
            F.when(whole | text.rlike(_NUMBER), F.trim(text).try_cast("double")), lambda number: read(text, mark, whole, number)))

    def read(text: Column, mark: Column, whole: Column, number: Column) -> Column:
        # No number is a name, and only whole ones can stand for a day or month.
        place = F.struct(F.when(whole, F.trim(text).try_cast("int")).alias("digits"),
                         F.when(number.isNull(), F.try_element_at(_names(), F.lower(text))).alias("name"))
        return bind(place, lambda p: bind(fraction(text, number, whole), lambda plain: F.struct(
            text.alias("text"), number.alias("num"), mark.alias("mark"), whole.alias("whole"),
            (F.signum(number) * F.floor(F.abs(number))).alias("cut0"),
            F.substring_index(plain, ".", 1).alias("lead"), F.substring_index(plain, ".", -1).alias("frac"),
            stands_for(p, "day", 7), stands_for(p, "month", 12))))

    def stands_for(p: Column, kind: str, top: int) -> Column:
        return F.coalesce(p["name"][kind], F.when(p["digits"].between(1, top), p["digits"])).alias(kind)

    def fraction(text: Column, number: Column, whole: Column) -> Column:
        # Exponents and trailing zeros away: the text a float prints as.
        decimal = F.when(F.trim(text).rlike(_PLAIN), F.trim(text)).otherwise(
            number.try_cast("decimal(38,12)").cast("string"))
        plain = F.regexp_replace(F.regexp_replace(decimal, r"0+$", ""), r"\.$", ".0")
        return F.when(number.isNotNull() & ~whole, plain)

    if not quoted:
        return shape(text, F.lit(False))
    mark = F.coalesce(text.startswith('"'), F.lit(False))
    return bind(mark, lambda m: bind(F.when(m, F.regexp_replace(text, r'(?s)^"(.*)"$', "$1")).otherwise(text), lambda t: shape(t, m)))


def _pair_equal(a: Column, b: Column, variant: str) -> Column:
    """Equality of two described values; NULL where the reference cannot compare."""
    same = a["text"].eqNullSafe(b["text"])
    gap = F.abs(a["num"] - b["num"])
    if variant == "v1":
        return same | F.coalesce(gap < TOLERANCE, F.lit(False))
    k = F.least(F.length(a["frac"]), F.length(b["frac"]))

    def cut(x: Column) -> Column:
        return F.concat(x["lead"], F.lit("."), F.substring(x["frac"], F.lit(1), k)).try_cast("double")

    cut_gap = F.abs(cut(a) - cut(b))
    cut_equal = cut_gap < TOLERANCE if variant == "v3" else cut_gap == 0
    # Cutting moves a number by less than 0.1, so distant ones need no texts.
    numeric = F.when(a["whole"] | b["whole"], a["cut0"] == b["cut0"]).otherwise((gap < 0.25) & cut_equal)
    both_days = a["day"].isNotNull() & b["day"].isNotNull()
    named = F.when(both_days, a["day"] == b["day"]).otherwise(F.coalesce(a["month"] == b["month"], F.lit(False)))
    null_against_whole = (a["text"].isNull() & b["whole"]) | (b["text"].isNull() & a["whole"])
    return (F.when(same, F.lit(True)).when(null_against_whole, F.lit(None).cast("boolean"))
            .when(F.coalesce(numeric, F.lit(False)), F.lit(True)).otherwise(named))


def values_equal(a: Column, b: Column, variant: str = "v1") -> Column:
    """Equality of two values; NULL marks a comparison the reference cannot do."""
    return _pair_equal(describe(a, variant), describe(b, variant), variant)


def _greedy(want: Column, have: Column, equal: Callable[[Column, Column], Column]) -> Column:
    """Each item of ``want`` takes the first equal item left in ``have``.

    Stops comparing after the first item without a partner; NULL (a comparison
    that cannot be done) ends the search as NULL.
    """
    start = F.struct(have.alias("left"), F.lit(True).alias("ok"))

    def look(item: Column) -> Callable[[Column, Column], Column]:
        # Place of the first hit, 0 so far; -1 after a comparison that cannot be done. Later items are not compared.
        def at(seen: Column, verdict: Column) -> Column:
            return F.struct((seen["i"] + 1).alias("i"), F.when(verdict.isNull(), -1).when(verdict, seen["i"] + 1).otherwise(0).alias("at"))

        return lambda seen, x: F.when(seen["at"] != 0, seen).otherwise(_let(equal(item, x), lambda verdict: at(seen, verdict)))

    def take(acc: Column, at: Column) -> Column:
        return F.struct(F.filter(acc["left"], lambda x, i: i != at - 1).alias("left"),
                        F.when(at < 0, F.lit(None).cast("boolean")).otherwise(at > 0).alias("ok"))

    def step(acc: Column, item: Column) -> Column:
        none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"))
        found = F.aggregate(acc["left"], none, look(item), lambda seen: seen["at"])
        return F.when(acc["ok"], _let(found, lambda at: take(acc, at))).otherwise(acc)

    return F.aggregate(want, start, step, lambda acc: acc["ok"])


def _bag_sorted(a: Column, b: Column) -> Column:
    """Texts equal as bags, numbers equal position by position once sorted.

    Sorted pairing minimises the largest gap, so it finds a pairing within the
    tolerance whenever one exists, in n log n instead of n squared.
    """
    def texts(x: Column) -> Column:
        return F.array_sort(F.transform(F.filter(x, lambda v: v["num"].isNull()), lambda v: v["text"]))

    def numbers(x: Column) -> Column:
        return F.array_sort(F.transform(F.filter(x, lambda v: v["num"].isNotNull()), lambda v: v["num"]))

    def close(na: Column, nb: Column) -> Column:
        return (F.size(na) == F.size(nb)) & F.forall(
            F.zip_with(na, nb, lambda p, q: F.coalesce(F.abs(p - q) < TOLERANCE, F.lit(False))), lambda ok: ok)

    return texts(a).eqNullSafe(texts(b)) & close(numbers(a), numbers(b))


def _lists_equal(a: Column, b: Column, ordered: Column, variant: str, pairing: str) -> Column:
    def equal(p: Column, q: Column) -> Column:
        return _pair_equal(p, q, variant)

    in_order = F.forall(F.zip_with(a, b, equal), lambda ok: ok)
    bag = _bag_sorted(a, b) if variant == "v1" and pairing == "sorted" else \
        F.when(a.eqNullSafe(b), F.lit(True)).otherwise(_greedy(a, b, equal))  # of equal lists each item takes its twin
    return F.when(F.size(a) != F.size(b), F.lit(False)).when(ordered, in_order).otherwise(bag)


def lists_equal(a: Column, b: Column, ordered: Column | bool = False, variant: str = "v1",
                pairing: str = "sorted") -> Column:
    """Equality of two value lists, in order or as bags."""
    flag = F.lit(ordered) if isinstance(ordered, bool) else ordered
    described = [F.transform(x, lambda v: describe(v, variant, inner=True)) for x in (a, b)]
    return _lists_equal(*described, flag, variant, pairing)


def _without_zeros(lists: Column) -> Column:
    zeros = F.array_distinct(F.flatten(F.transform(lists, lambda l: F.filter(
        F.transform(l, lambda v, i: F.when((v["num"] == 0) & ~v["mark"], i)), lambda i: i.isNotNull()))))
    return _let(zeros, lambda z: F.when(F.size(z) == 0, lists).otherwise(
        F.transform(lists, lambda l: F.filter(l, lambda v, i: ~F.array_contains(z, i)))))


def drop_zero_positions(lists: Column, quoted: bool = False) -> Column:
    """Remove the positions at which any list holds the number zero; the text "0" stays if values are ``quoted``."""
    described = F.transform(lists, lambda l: F.transform(l, lambda v: describe(v, quoted=quoted, inner=True)))
    return F.transform(_without_zeros(described), lambda l: F.transform(l, lambda v: v["text"]))


def list_match(expected: Column, predicted: Column, ordered: Column | bool = False,
               variant: str = "v1", pairing: str = "sorted", quoted: bool = False) -> Column:
    """Every expected list equals a predicted list of its own.

    Extra predicted lists are allowed. The comparison stays inside the row. Plain values
    are numbers where they read as such; ``quoted`` ones are JSON texts (``json_lists``),
    of which v3 drops the zeros that are numbers and keeps the strings.
    """
    flag = F.lit(ordered) if isinstance(ordered, bool) else ordered

    def prepared(lists: Column) -> Column:
        described = F.transform(lists, lambda l: F.transform(l, lambda v: describe(v, variant, quoted, True)))
        return _let(described, _without_zeros) if variant == "v3" else described

    matched = _greedy(prepared(expected), prepared(predicted),
                      lambda p, q: _lists_equal(p, q, flag, variant, pairing))
    return F.when(F.size(expected) > F.size(predicted), F.lit(False)).otherwise(matched)


def json_lists(text: Column) -> Column:
    """Lists of values from a JSON text, strings with their quotation marks and the rest bare."""
    lists = F.from_json(text, "array<array<variant>>")
    return F.transform(lists, lambda l: F.transform(l, lambda v: F.when(~F.is_variant_null(v), F.to_json(v))))
