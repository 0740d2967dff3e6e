"""Typed values mapped to the nearest entry of a reference list, or reported as having none.

Only distinct values are resolved; rows get the answer of their value back. The reference list is
broadcast as a symmetric-delete dictionary while it has at most MAX_BROADCAST entries; a longer list
is joined on its deletes instead, and only the pairs that meet there are ranked.

Edge cases: null values are left out; an empty value, or one without letters and digits, has no entry;
two entries at one distance are told apart by their frequency in the data, and by key if that ties too;
an empty reference list makes every value a miss; repeated rows each get a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.symmetric_delete import SymmetricDeleteIndex, deletes, weighted_distance

NONE = "none"
MAX_BROADCAST = 50_000
#: What a typed text that may have an edit leaves without it is at least so long; shorter deletes meet nothing.
SHORTEST = 3
#: Words that a typed name may carry besides the entry (fixed values).
_AROUND = re.compile(r"\b(?:division|segment|segments|business|unit|external|internal|total|sparte|secteur|segmento|settore|segmentet)\b")
_NUMBERING = re.compile(r"^\s*(?:\(?[a-z0-9]{1,2}[.)]|[ivx]{1,4}[.)]|\d+(?:\.\d+)*[.)]?|[-•*–])\s+", re.I)
_NOTE = re.compile(r"\s*(?:\(\d+\)|\[\d+\]|[¹²³*†‡]+|[.:;,]+)\s*$")


#: Words for "and" in the languages of the lists (fixed values).
_AND = ("and", "und", "et", "y", "e", "en", "og")


def words_only(text: str) -> str:
    """Lower case, no accents, marks and numbering around the name removed, anything but letters and digits as one blank."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text.strip().lower()) if not unicodedata.combining(c))
    for _ in range(3):
        text = _NOTE.sub("", _NUMBERING.sub("", text)).strip()
    return re.sub(r"[^\w&]+|_", " ", text).strip()


def name_forms(text: str) -> list[str]:
    """A typed name as it stands, with the parts about its comma exchanged, and without words around the name."""
    forms = [words_only(text)]
    if text.count(",") == 1:
        a, b = text.split(",")
        forms.append(words_only(words_only(b) + " " + words_only(a)))
    forms += [f for f in (re.sub(r"\s+", " ", _AROUND.sub(" ", x)).strip() for x in list(forms)) if f and f not in forms]
    forms = [re.sub(r"\s*[&+]\s*", f" {a} ", f) for f in forms for a in (_AND if "&" in f or "+" in f else _AND[:1])]
    return [f for f in dict.fromkeys(forms) if re.search(r"[^\W\d_]", f)]


def is_abbreviation(short: str, long: str) -> bool:
    """short has the first letter of long and its other letters in order."""
    letters = iter(long)
    return len(short) >= 3 and short[0] == long[0] and all(c in letters for c in short)


def abbreviates(form: str, label: str) -> bool:
    """Word by word the same or abbreviated; a single word must be the beginning of the other."""
    a, b = form.split(), label.split()
    if len(a) != len(b) or form == label:
        return False
    if len(a) == 1:
        return len(form) >= 5 and label.startswith(form)
    return any(x == y or y.startswith(x) for x, y in zip(a, b)) and all(x == y or is_abbreviation(x, y) for x, y in zip(a, b))


def limit_of(text: str) -> float:
    """How far an entry may be: one edit in short texts, two in long ones."""
    n = len(text)
    return 0.0 if n < 4 else 1.0 if n < 9 else 2.0


def _initials(words: list[str]) -> str:
    """What an abbreviation has in common with its label: the number of words and their first letters, or the beginning of the only word."""
    return "a:" + (words[0][:5] if len(words) == 1 else " ".join(w[:1] for w in words))


def _aids(index: SymmetricDeleteIndex, labels: dict[str, str]) -> tuple[dict[str, list[str]], set[str]]:
    """The labels by their initials, and the codes: made once for an index and its labels."""
    if getattr(index, "aids", None) is None or index.aids[0] is not labels:
        by_initials: dict[str, list[str]] = {}
        for label in labels:
            if label:
                by_initials.setdefault(_initials(label.split()), []).append(label)
        index.aids = labels, by_initials, set(labels.values())
    return index.aids[1:]


def best_name(text: str, index: SymmetricDeleteIndex, labels: dict[str, str]) -> str:
    best: list[tuple[float, float, str]] = []
    for form in name_forms(text):
        best += index.lookup(form, limit_of(form))
    if best:
        return min(best)[2]
    by_initials, _ = _aids(index, labels)
    for form in name_forms(text):
        keys = {labels[label] for label in by_initials.get(_initials(form.split()), ()) if abbreviates(form, label)}
        if len(keys) == 1:
            return keys.pop()
    return NONE


# Letters that stand for digits in a typed code.
_DIGITS = str.maketrans({"l": "1", "i": "1", "|": "1", "o": "0", "s": "5", "b": "8", "z": "2", "g": "9", "q": "9"})
_CODE = re.compile(r"^(?P<a>[\doilsbzgq|]{1,2})\s*[.,/\-:\s]\s*(?P<b>[\doilsbzgq|]{2})$|^(?P<c>[\doilsbzgq|]{3,4})$")
_AROUND_CODE = re.compile(r"\b(?:nace|rev|code|class|klasse|classe|isic)\b[.:#]?|[#:]|\br\.?2\b")


_CODE_BESIDE = re.compile(r"[(\[]?\b[A-Za-z]?\s?[\dOolI]{1,2}\s?[.,/\-]\s?[\dOolI]{2}\b[)\]]?")
_CODE_PART = re.compile(r"\b[\dOolI]{1,2}[.,/\-][\dOolI]{2}\b")


def code_readings(text: str) -> list[str]:
    """The class codes that a text may be, in one of the usual notations."""
    text = re.sub(r"\s+", " ", _AROUND_CODE.sub(" ", text.lower())).strip(" .;,()[]")
    readings = []
    for t in (text, re.sub(r"^[a-z]\s*(?=[\doil]{2})", "", text)):
        m = _CODE.match(t)
        if not m or not re.search(r"\d", t):
            continue
        if m["a"]:
            readings.append((m["a"].translate(_DIGITS).zfill(2), m["b"].translate(_DIGITS)))
        else:
            c = m["c"].translate(_DIGITS).zfill(4)
            readings.append((c[:2], c[2:]))
    return [f"{a}.{b}" for a, b in readings]


def read_code(text: str, codes: set[str]) -> str | None:
    """The class code that a text is; None if it isn't one of codes."""
    return next((c for c in code_readings(text) if c in codes), None)


def best_class(text: str, index: SymmetricDeleteIndex, labels: dict[str, str]) -> str:
    """A class code: by its notation, by a code beside a name, or by the name alone."""
    codes = _aids(index, labels)[1]
    whole = read_code(text, codes)
    if whole:
        return whole
    name = _CODE_BESIDE.sub(" ", text)
    by_name = best_name(name, index, labels) if re.search(r"[^\W\d_]{3}", name) else NONE
    if by_name != NONE:
        return by_name
    beside = [c for c in (read_code(x, codes) for x in _CODE_PART.findall(text)) if c]
    return beside[0] if len(set(beside)) == 1 and re.search(r"[^\W\d_]{3}", name) else NONE


def resolve(values: DataFrame, reference: DataFrame, best: Callable[[str, SymmetricDeleteIndex, dict[str, str]], str] = best_name) -> DataFrame:
    """values(value) -> value, ref_key. reference(label, key, frequency); `best` picks among the broadcast entries."""
    spark = values.sparkSession
    listed = reference.where(F.col("label").isNotNull() & F.col("key").isNotNull()).select("label", "key", F.coalesce("frequency", F.lit(0)).cast("double").alias("frequency"))
    entries = listed.limit(MAX_BROADCAST + 1).collect()
    distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
    if len(entries) > MAX_BROADCAST:
        return resolve_by_join(distinct, listed, best=best)
    listed_rows = sorted((words_only(r.label), r.key, r.frequency) for r in entries)
    shared = spark.sparkContext.broadcast(listed_rows)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = SymmetricDeleteIndex(shared.value)
        labels = {text: key for text, key, _ in shared.value}
        for batch in batches:
            yield pd.DataFrame({"value": batch["value"], "ref_key": [best(v, index, labels) for v in batch["value"]]})

    # few values make one partition of little data, but each of them takes a while
    return distinct.repartition(spark.sparkContext.defaultParallelism).mapInPandas(look_up, "value string, ref_key string")


def _value_keys(value: str, most: int) -> list[str]:
    """The keys of all labels that a value may mean: within edits, as an abbreviation, by a code in it."""
    forms = {f for x in (value, _CODE_BESIDE.sub(" ", value)) for f in name_forms(x)}
    codes = {c for x in (value, *_CODE_PART.findall(value)) for c in code_readings(x)}
    return sorted({f"d:{d}" for f in forms for d in deletes(f, min(most, int(limit_of(f) + 0.999)))} | {_initials(f.split()) for f in forms} | {f"c:{c}" for c in codes})


def _label_keys(label: str, key: str, most: int) -> list[str]:
    text = words_only(label)
    return sorted({f"d:{d}" for d in deletes(text, most) if len(d) >= SHORTEST or d == text} | ({_initials(text.split())} if text else set()) | {f"c:{key}"})


def resolve_by_join(distinct: DataFrame, listed: DataFrame, most: int = 2, best: Callable[[str, SymmetricDeleteIndex, dict[str, str]], str] = best_name) -> DataFrame:
    """The same for a list of any length: `best` picks among the entries that a value meets on deletes, on a code, or as an abbreviation."""

    @F.pandas_udf("array<string>")
    def value_keys(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _value_keys(v, most))

    @F.pandas_udf("array<string>")
    def label_keys(labels: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([_label_keys(x, k, most) for x, k in zip(labels, keys)], dtype=object)

    @F.pandas_udf("boolean")
    def fits(values: pd.Series, labels: pd.Series, by: pd.Series) -> pd.Series:  # of those that share first letters, few are abbreviated
        forms = lambda v: {f for x in (v, _CODE_BESIDE.sub(" ", v)) for f in name_forms(x)}
        return pd.Series([b[:2] != "a:" or any(abbreviates(f, words_only(x)) for f in forms(v)) for v, x, b in zip(values, labels, by)], dtype=bool)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, near in zip(batch["value"], batch["near"]):
                entries = sorted((words_only(x["label"]), x["key"], x["frequency"]) for x in (() if near is None else near))
                out.append(best(value, SymmetricDeleteIndex(entries), {text: key for text, key, _ in entries}))
            yield pd.DataFrame({"value": batch["value"], "ref_key": out})

    left = distinct.select("value", F.explode(value_keys("value")).alias("k"))
    right = listed.select("label", "key", "frequency", F.explode(label_keys("label", "key")).alias("k"))
    near = left.join(right, "k").where(fits("value", "label", "k")).select("value", F.struct("label", "key", "frequency").alias("x")).groupBy("value").agg(F.collect_set("x").alias("near"))
    return distinct.join(near, "value", "left").select("value", "near").mapInPandas(pick, "value string, ref_key string")
