"""Text normalisers and term matching. The normalisers differ on purpose: each has its own callers.

All of them give null for null, and an empty text for a text without anything they keep.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks, and what they are without.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝĀĂĄĆĈĊČĎĒĔĖĘĚĜĞĠĢĤĨĪĬĮĴĶĹĻĽŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŸŹŻŽ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzAAAAAACEEEEIIIINOOOOOUUUUYAAACCCCDEEEEEGGGGHIIIIJKLLLNNNOOORRRSSSSTTUUUUUUWYYZZZ"


def strip_marks(text: Column) -> Column:
    """Letters without accents."""
    return F.translate(text, _MARKED, _PLAIN)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_ascii(text: Column) -> Column:
    """Accents off, what isn't ASCII dropped, lower case, blanks squeezed."""
    return squeeze(F.lower(F.regexp_replace(strip_marks(text), r"[^\x00-\x7F]", "")))


def lower_squeezed(text: Column) -> Column:
    """Lower case and squeezed; accents stay."""
    return squeeze(F.lower(text))


def alnum_words(text: Column) -> Column:
    """Lower case, anything but a-z and 0-9 a blank (an accented letter too)."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# Labels in other languages and their English meaning, replaced as whole words in this order.
MEANINGS = {
    "i alt": "total", "yhteensa": "total", "gesamt": "total", "insgesamt": "total", "summe": "total", "totale": "total", "totaal": "total", "totalt": "total", "summa": "total",
    "eliminierungen": "eliminations", "eliminering": "eliminations", "elimineringar": "eliminations", "eliminaciones": "eliminations", "eliminacoes": "eliminations", "eliminazioni": "eliminations", "eliminaties": "eliminations",
    "reconciliacion": "reconciliation", "conciliacion": "reconciliation", "uberleitung": "reconciliation", "abstimmung": "reconciliation", "rapprochement": "reconciliation", "riconciliazione": "reconciliation", "reconciliatie": "reconciliation",
    "niet toegewezen": "unallocated", "nicht zugeordnet": "unallocated", "non alloue": "unallocated", "no asignado": "unallocated", "ikke allokeret": "unallocated",
}


def english_meaning(text: Column) -> Column:
    """A label in lower-case ASCII with known foreign words in English."""
    label = F.regexp_replace(F.lower(strip_marks(text)), "[—–]", " ")
    label = squeeze(F.regexp_replace(F.replace(label, F.lit("ß"), F.lit("ss")), r"[^a-z0-9&/,+.\-\s]", " "))
    # one pass for all words of one meaning: none of them is part of another as a whole word
    for english in dict.fromkeys(MEANINGS.values()):
        words = "|".join(re.escape(f) for f, e in MEANINGS.items() if e == english)
        label = F.regexp_replace(label, rf"\b(?:{words})\b", english)
    return squeeze(label)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# Words that say nothing about an activity.
STOPWORDS = "and are as at business businesses by company division for from group in of on operations other products revenue segment segments service services solutions the to with".split()


def content_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Distinct lower-case words of more than two characters that aren't stopwords, in order."""
    return F.array_distinct(content_words(text, stopwords))


def content_words(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """content_tokens with repetitions."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stopwords))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs, as a substring."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def term_pattern(term: str) -> str:
    """A phrase or symbol anywhere, a single word between word borders."""
    return re.escape(term) if " " in term or "&" in term or term == "$" else rf"\b{re.escape(term)}\b"


def matched_terms(normalised: Column, terms: Sequence[str]) -> Column:
    """The terms that occur in a text normalised by fold_ascii, sorted."""
    return F.array_compact(F.array(*[F.when(normalised.rlike(term_pattern(t)), F.lit(t)) for t in sorted(terms)]))


def nonblank_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: squeeze(x)), lambda x: x != "")


def redact(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Keys, tokens and the given secrets replaced by a mark."""
    hidden = F.regexp_replace(text, r"(?i)\b(sk|pk|api|key|token)[-_][A-Za-z0-9_\-]{8,}", "[redacted]")
    for s in secrets:
        hidden = F.replace(hidden, F.lit(s), F.lit("[redacted]"))
    return hidden


# What gives a label's language away, tried in this order.
LANGUAGE_HINTS = [
    ("de", ["nicht ", "gesamt", "umsatz", "uberleitung"]), ("fr", ["chiffre d affaires", "non alloue", "sous total"]), ("es", ["ingresos", "no asignado", "reconciliacion"]),
    ("it", ["ricavi", "non allocato", "riconciliazione"]), ("nl", ["omzet", "niet toegewezen", "reconciliatie"]), ("da", ["i alt", "ikke allokeret"]),
]


def label_language(text: Column) -> Column:
    """The first language whose hint occurs, else English; null for an empty label."""
    plain = squeeze(F.lower(strip_marks(text)))
    found = F.when(english_meaning(text) == "", F.lit(None).cast("string"))
    for code, hints in LANGUAGE_HINTS:
        found = found.when(contains_any(plain, hints), F.lit(code))
    return found.otherwise(F.lit("en"))


# Function words counted by the marker-based detector.
MARKERS = {"en": ["the", "and", "of"], "de": ["der", "und", "die"], "fr": ["les", "des", "et"], "es": ["los", "las", "del"], "it": ["che", "della", "il"], "nl": ["het", "een", "van"], "da": ["og", "det", "af"]}


def marker_language(text: Column, markers: dict[str, Sequence[str]] | None = None) -> Column:
    """The language whose markers occur most often as words; 'unknown' if none or several do."""
    low = F.lower(text)
    counted = F.array(*[
        F.struct(F.regexp_count(low, F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])")).alias("n"), F.lit(code).alias("code"))
        for code, words in (markers or MARKERS).items()
    ])
    most = F.array_max(F.transform(counted, lambda x: x["n"]))
    top = F.filter(counted, lambda x: x["n"] == most)
    return F.when((most > 0) & (F.size(top) == 1), F.element_at(top, 1)["code"]).otherwise(F.lit("unknown"))


def low_text_count(text: Column) -> Column:
    """How many letters and digits a text has."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))
