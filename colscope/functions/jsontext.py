"""JSON text: validity, recovery from model answers, and nested key search."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Chart words, removed one after another in this order.
CHART_TERMS = ["Grouping Scatter", "Scatter", "Pie", "Line", "Stacked Bar", "Grouping Line", "Bar"]


def mask_chart_terms(text: Column, terms: Sequence[str] = CHART_TERMS) -> Column:
    """Remove every chart word, whatever its case."""
    for term in terms:
        text = F.regexp_replace(text, f"(?i){term}", "")
    return text


_PARTS = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++|"'


def lenient(text: Column, control: bool = True) -> Column:
    """JSON as model answers write it: raw control characters inside texts are escaped (with ``control``),
    bare NaN and infinities become null. Other texts are returned as they are."""
    def part(p: Column) -> Column:
        quoted = p
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) if control else ():
            quoted = F.replace(quoted, F.lit(raw), F.lit(shown))
        quoted = F.regexp_replace(quoted, r"[\x00-\x1f]", " ") if control else quoted
        return F.when(p.startswith('"'), quoted).otherwise(F.regexp_replace(p, r"(?<![\w.])-?(?:NaN|Infinity)(?![\w.])", "null"))

    odd = text.rlike(r"[\x00-\x1f]|NaN|Infinity" if control else "NaN|Infinity")
    return F.when(odd, F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PARTS), 0), part), "")).otherwise(text)


def is_json(text: Column, strict: bool = False) -> Column:
    """True when the whole text is one JSON value, read as ``json.loads`` does.

    NaN and infinities and repeated keys are allowed, raw control characters inside texts
    unless ``strict``. The parser stops after the first value, so the text is read inside a
    list and inside an object: trailing text breaks at least one of them.
    """
    text = lenient(text, not strict)
    listed, keyed = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"r":'), text, F.lit("}"))
    in_list, in_object = F.try_parse_json(listed), F.try_parse_json(keyed)
    first = F.try_variant_get(in_list, "$[0]", "variant").isNotNull()
    plain = in_list.isNotNull() & in_object.isNotNull() & first & F.try_variant_get(in_list, "$[1]", "variant").isNull()
    # The variant parser refuses repeated keys; a text that may hold some goes through the other one.
    names = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]++|\\.)*+)"\s*:'), 1)
    options = {"allowSingleQuotes": "false"}
    tolerant = (F.size(F.from_json(listed, "array<string>", options)) == 1) & (F.size(F.map_keys(F.from_json(keyed, "map<string,string>", options))) == 1)
    return F.coalesce(F.when(plain, F.lit(True)).when(F.size(F.array_distinct(names)) < F.size(names), tolerant), F.lit(False))


def last_keys(text: Column) -> Column:
    """JSON text in which the last of equal keys stands; meant for the few texts that have such keys, NULL for others."""
    def settled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t, strict=False), ensure_ascii=False, separators=(",", ":")))

    return F.pandas_udf(settled, "string")(text)


def clean_response(text: Column) -> Column:
    """Strip code fences, a byte-order mark, prose around the JSON and trailing commas."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "```(json)?", "")
    bare = F.regexp_replace(bare, "^\\x{FEFF}", "")
    # From the first bracket to the last bracket of the same kind, or to the end without one.
    inner = F.when(bare.rlike(r"(?s)^[^\[]*\{.*\}"), F.regexp_extract(bare, r"(?s)^[^{\[]*(\{.*\})", 1)) \
        .when(bare.rlike(r"(?s)^[^{]*\[.*\]"), F.regexp_extract(bare, r"(?s)^[^{\[]*(\[.*\])", 1)) \
        .otherwise(F.regexp_extract(bare, r"(?s)([{\[].*)", 1))
    chosen = F.when((inner != "") & is_json(inner), inner).otherwise(bare)
    commas = F.regexp_replace(chosen, r",(\s*[}\]])", "$1")
    return F.regexp_replace(commas, r"^\s+|\s+$", "")


def recover_json(cleaned: Column) -> Column:
    """The text itself, else wrapped in braces, else with double quotes; NULL when none parses.

    Repaired texts are read strictly, as they are by ``json.loads`` without options.
    """
    wrapped = F.concat(F.lit("{"), cleaned, F.lit("}"))
    braced = cleaned.startswith("{") & cleaned.endswith("}")
    quoted = F.replace(cleaned, F.lit("'"), F.lit('"'))
    return (F.when(is_json(cleaned), cleaned)
            .when(~braced & is_json(wrapped, True), wrapped)
            .when((quoted != cleaned) & is_json(quoted, True), quoted))


def parse_responses(df: DataFrame, text: str) -> DataFrame:
    """Add ``valid``, ``data`` (JSON text of the object) and ``errors`` for each answer.

    Steps are columns of their own so that no parse is repeated. Empty values are
    invalid without an error, as are objects with no key.
    """
    stepped = (df.withColumn("_clean", clean_response(F.col(text)))
               .withColumn("_raw", recover_json(F.col("_clean")))
               .withColumn("_json", lenient(F.col("_raw")))
               .withColumn("_json", F.coalesce(last_keys(F.when(F.try_parse_json("_json").isNull(), F.col("_json"))), "_json"))
               .withColumn("_first", F.substring("_json", 1, 1)))
    hollow = F.col("_json").rlike(r'^(\{\s*\}|\[\s*\]|-?0+(\.0+)?|""|null|false)$')
    good = F.col("_json").isNotNull() & ~hollow & (F.col("_first") == "{")
    errors = (F.when(F.col("_json").isNull(), F.array(F.lit("not readable as JSON")))
              .when(~hollow & (F.col("_first") != "{"), F.array(F.lit("root is not an object")))
              .otherwise(F.array().cast("array<string>")))
    return (stepped.withColumn("valid", F.coalesce(good, F.lit(False)))
            .withColumn("data", F.when(good, F.col("_json")))
            .withColumn("errors", errors)
            .drop("_clean", "_raw", "_json", "_first"))


_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{}:,])|("[^"\\]*(?:\\.[^"\\]*)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S)


def walk_keys(text: str | None, keys: Sequence[str]) -> tuple[list[str | None], list[str | None]] | None:
    """First value, and first value that is not null, of each key in reading order.

    One pass over the tokens with a stack of open brackets: linear in the text, at
    any depth. Nested values are given as their JSON text, texts as what they say.
    None when the text is not one JSON value.
    """
    wanted = {k: i for i, k in enumerate(keys)}
    first: list[str | None] = [None] * len(keys)
    solid: list[str | None] = [None] * len(keys)
    met = [False] * len(keys)
    stack: list[tuple[str, int | None, int]] = []
    expect, key, at, text = "value", None, 0, text or ""

    def found(i: int | None, value: str | None, order: int) -> None:
        if i is None:
            return
        if not met[i] or slots[i] > order:
            first[i], met[i], slots[i] = value, True, order
        if value is not None and (solid[i] is None or solids[i] > order):
            solid[i], solids[i] = value, order

    slots, solids = [0] * len(keys), [0] * len(keys)
    while expect != "end":
        token = _TOKEN.match(text, at)
        if not token:
            return None
        mark, string, literal = token.groups()
        start, at = token.start(token.lastindex), token.end()
        closed = None
        if mark in ("}", "]") and stack and stack[-1][0] == mark and expect in ("comma", "open" + mark):
            closed = stack.pop()
        elif expect in ("value", "open]") and mark in ("{", "["):
            stack.append(("}" if mark == "{" else "]", key, start))
            expect, key = ("open}" if mark == "{" else "open]"), None
        elif expect in ("value", "open]") and (string or literal):
            value = json.loads(string, strict=False) if string else None if literal == "null" else literal
            found(key, value, start)
            key, expect = None, "comma"
        elif expect in ("key", "open}") and string:
            key, expect = wanted.get(json.loads(string, strict=False)), "colon"
        elif expect == "colon" and mark == ":":
            expect = "value"
        elif expect == "comma" and mark == ",":
            expect = "key" if stack[-1][0] == "}" else "value"
        else:
            return None
        if closed:
            found(closed[1], text[closed[2]:at], closed[2])
            expect = "comma"
        if expect == "comma" and not stack:
            expect = "end"
    return None if text[at:].strip(" \t\r\n") else (first, solid)


_QUOTED = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"([ \t\r\n]*:[ \t\r\n]*)?', re.S)


def _no_json(name: str) -> None:
    raise ValueError(name)


def json_reader() -> json.JSONDecoder:
    """Reader of strict JSON; numbers stay texts, as nothing is read of them but where they end."""
    return json.JSONDecoder(strict=False, parse_int=str, parse_float=str, parse_constant=_no_json)


def scan_keys(text: str | None, keys: Sequence[str], reader: json.JSONDecoder) -> tuple[list[str | None], list[str | None]] | None:
    """What ``walk_keys`` finds, by the json module's reader.

    One call tells whether the text is JSON. In JSON a string before a colon is a key, so the
    strings are then passed over once, and only the values of wanted keys are read again, one
    of a key at most besides nulls. Texts too deep for the reader are walked token by token.
    """
    if not text:
        return None
    try:
        reader.decode(text)
        left, first, solid = set(keys), {}, {}
        for token in _QUOTED.finditer(text):
            name, colon = token.groups()
            if colon is None:
                continue
            key = json.loads(token[0][:len(name) + 2], strict=False) if "\\" in name else name
            if key not in left:
                continue
            start = token.end()
            value, end = reader.raw_decode(text, start)
            # A text is what it says, other values stay as they are written.
            shown = None if value is None else value if text[start] == '"' else text[start:end]
            first.setdefault(key, shown)
            if shown is not None:
                solid[key] = shown
                left.remove(key)
                if not left:
                    break
    except RecursionError:
        return walk_keys(text, keys)
    except ValueError:
        return None
    return [first.get(k) for k in keys], [solid.get(k) for k in keys]


def find_keys(df: DataFrame, text: str, keys: Sequence[str], skip_null: bool = False, suffix: str | None = None) -> DataFrame:
    """First value of each key at any depth, in reading order, as columns of JSON text.

    Each document is read in an Arrow batch: the plan does not know how deep
    documents are, and nothing is shuffled. A JSON null counts as found unless
    ``skip_null``. With ``suffix`` both readings come from the one walk: the plain
    names take nulls, the suffixed ones do not. A text that is not JSON has no keys.
    """
    names = list(keys)
    shape = ", ".join(f"f{i} string, s{i} string" for i in range(len(names)))

    @F.pandas_udf(f"struct<{shape}>")
    def search(texts: pd.Series) -> pd.DataFrame:
        rows, reader = [], json_reader()
        for value in texts:
            got = scan_keys(value, names, reader)
            rows.append([x for pair in zip(*got) for x in pair] if got else [None] * (2 * len(names)))
        return pd.DataFrame(rows, columns=[f"{kind}{i}" for i in range(len(names)) for kind in "fs"], dtype=object)

    out = df.withColumn("_keys", search(F.col(text)))
    columns = [F.col(f"_keys.{'s' if skip_null else 'f'}{i}").alias(k) for i, k in enumerate(names)]
    if suffix:
        columns += [F.col(f"_keys.s{i}").alias(k + suffix) for i, k in enumerate(names)]
    return out.select(*df.columns, *columns)
