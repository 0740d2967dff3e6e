"""JSON in and around text: recovery from a model's answer, strict schemas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)


def first_balanced(text: str, opening: str = "{", after: str = "") -> str | None:
    """The first balanced {...} or [...] after a marker; brackets inside strings don't count."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening, text.find(after) + len(after) if after and after in text else 0)
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)) if start >= 0 else ():
        c = text[k]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[start : k + 1]
    return None


@F.pandas_udf(T.StringType())
def recover_json(answers: pd.Series) -> pd.Series:
    """The JSON object of an answer: its fenced block, else the first balanced braces; null if neither."""
    found = []
    for a in answers:
        m = _FENCE.search(a) if a else None
        body = m.group(1) if m and m.group(1).strip().startswith(("{", "[")) else a
        found.append(first_balanced(body) if body else None)
    return pd.Series(found, dtype=object)


def schema_errors(text: Column, names: list[str]) -> Column:
    """What is wrong with a JSON object against a fixed set of keys: 'invalid', 'missing x', 'extra y'; empty if nothing."""
    wanted, keys = F.array(*[F.lit(n) for n in names]), F.json_object_keys(text)
    absent = F.transform(F.array_except(wanted, keys), lambda k: F.concat(F.lit("missing "), k))
    extra = F.transform(F.array_except(keys, wanted), lambda k: F.concat(F.lit("extra "), k))
    return F.when(keys.isNull(), F.array(F.lit("invalid"))).otherwise(F.concat(absent, extra))


def value_errors(text: Column, shares: list[str] = (), texts: list[str] = ()) -> Column:
    """What is wrong with a JSON object's values: 'not a share x' (a number from 0 to 1), 'empty y' (a text with more than blanks); keys that are missing are schema_errors()' matter."""
    at = lambda k: F.get_json_object(text, f"$.{k}")
    number = lambda k: at(k).try_cast("double")
    wrong = [F.when(at(k).isNotNull() & ~F.coalesce(number(k).between(0, 1), F.lit(False)), F.lit(f"not a share {k}")) for k in shares]
    wrong += [F.when(at(k).isNotNull() & (F.trim(at(k)) == ""), F.lit(f"empty {k}")) for k in texts]
    return F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
