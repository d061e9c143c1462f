"""JSON fields as columns, with the comparison rules of the query language."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

SCALARS = ("STRING", "BOOLEAN", "BIGINT", "DOUBLE")


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def kind_of(data: Column, key: str) -> Column:
    """The JSON type name of a top-level key; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), _path(key), "variant"))


def scalar(data: Column, key: str) -> Column:
    """A top-level key's scalar as text; null for null, arrays, objects and missing keys."""
    kind = kind_of(data, key)
    return F.when(kind.isin(*SCALARS) | kind.startswith("DECIMAL"), F.get_json_object(data, _path(key)))


def text(data: Column, key: str) -> Column:
    """A top-level key's value if it is a JSON string."""
    return F.when(kind_of(data, key) == "STRING", F.get_json_object(data, _path(key)))


def any_value(data: Column, key: str) -> Column:
    return F.get_json_object(data, _path(key))


def compare(value: Column, op: str, literal: str) -> Column:
    """``value op literal``; false where the value is null or cannot be compared."""
    if op == "=":
        test = value == literal
    elif op in ("<>", "!="):
        test = value != literal
    elif op == "=~":
        test = regex(value, literal)
    else:
        number = F.expr(f"try_cast('{re.sub(chr(39), '', literal)}' as double)")
        left = value.try_cast("double")
        test = {"<": left < number, "<=": left <= number, ">": left > number, ">=": left >= number}[op]
    return F.coalesce(test, F.lit(False))


def regex(value: Column, pattern: str) -> Column:
    """Unanchored search; a pattern that a linear-time engine cannot run is a substring."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k", pattern):
        return value.contains(pattern)
    try:
        re.compile(pattern)
    except re.error:
        return value.contains(pattern)
    return value.rlike(pattern)


def glob_pattern(pattern: str) -> str:
    """An anchored regular expression for ``*``, ``?`` and ``[...]``, case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            negate = body[:1] in "^!"
            out.append("[" + ("^" if negate else "") + body[negate:].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
