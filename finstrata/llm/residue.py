"""Template residue, filler and error pages among records that should hold content.

One pass cuts each text into segments (sentences and lines), reads each as a filling of a template, and reports
marked tokens such as {{ name }} or [insert amount] with the words around them, and paragraphs without a single
function word (filler). Small aggregations then align what is alike:
  * sentences are one template if they are equal without what may fill a slot: numbers, names, marked tokens, bare
    names of variables, defaults. A place that most sentences of a template fill, and not all alike, is a slot; a
    sentence that has a mark, a name of a variable, a default or nothing there was left unfilled; sentences and
    marks may be of any length;
  * a marked token is an unfilled slot if the text around it varies from record to record, if one sentence of its
    template is filled in its place, or if its form is a name; other tokens that always stand in the same words are
    template text (footnote marks in a fixed sentence, an example of a data format), however often they are seen;
  * a template is an error page's if it recurs, over more than one source, and makes up PAGE_SHARE of its record so
    often that it is no chance: what servers and viewers say in place of a report, in any words and of any length;
  * a sentence of a few words that never varies is filler if it recurs, over more than one source, and here and there
    makes up much of a record, for there prose never stands alone.
No message is known beforehand: what occurs fewer than min_records times (error pages: 3 times) is not induced.

Edge cases: null or empty texts are never residue; repeated records are judged alike; a table without a column of
sources is judged by recurrence alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.runtime import cut

# Forms that only templates use: a name between doubled or paired marks (fixed patterns), each searched where its first characters occur.
_STRONG = [(first, re.compile(pattern)) for first, pattern in (
    ("{{", r"\{\{\s*[\w.\- ]*\s*\}\}"), ("{%", r"\{%(?:(?!\{%|%\}).)*%\}"), ("${", r"\$\{[\w.\- ]*\}"), ("<%", r"<%(?:(?!<%|%>).)*%>"), ("%", r"%%\w+%%|(?<![\w%])%[A-Z][A-Z_]{2,}%"), ("@@", r"@@\w+@@"),
    ("__", r"(?<!\w)__[A-Za-z]\w*?__(?!\w)|_{4,}"), ("[[", r"\[\[[\w .\-]+\]\]"), ("<<", r"<<[\w .\-]+>>"), ("#", r"#REF!|#NAME\?|#VALUE!|#DIV/0!|#N/A\b"), ("«", r"«[\w .\-]{1,40}»(?=[ .,;:)\]]|$)"),
    ("{", r"\{\d{1,2}\}"), ("$", r"(?<![\w$])\$[A-Z][A-Z_]{3,}\$"), ("X", r"(?<!\w)X{2,}[.,]X+(?!\w)"),
    ("[", r"\[[^\[\]]{0,30}\b(?i:insert|tbc|tbd|to be (?:completed|confirmed|added|filled)|placeholder|einfügen|insérer|insertar|inserire|invoegen|indsæt)\b[^\[\]]*\]|\[[•●▪◦…_]+\]"),
)]
# Forms that may also be ordinary: judged by whether the words around them vary.
_WEAK = re.compile(r"\[[^\[\]\n]*\]|<[A-Za-z][\w .\-]*>|\{[\w .\-]+\}|«[^«»\n]{1,40}»|(?<![\w.])X{2,}(?![\w.])|\bT(?:BC|BD|ODO)\b")
_MARKUP = re.compile(r"^</?(?:p|br|b|i|u|em|strong|a|div|span|li|ul|ol|td|tr|th|table|h[1-6]|sup|sub|small|html|body|head|title|img|hr|pre|code|blockquote)(?:\s[^>]*)?/?>$", re.I)
_FOOTNOTE = re.compile(r"^\[(?:\d{1,3}|[a-z]|sic|\.{3}|…)\]$")

# The commonest words of the seven languages (fixed values): prose has one of them every few words.
FUNCTION_WORDS = frozenset(
    "the of and to in a an is was for on by with from at that which had as its their this be are been were or not no "
    "der die das und von in den dem des zu mit auf für ist war im eine ein einen wurde werden sich nicht nach bei "
    "le la les de des du et en un une à au aux est dans sur pour par que qui dont plus "
    "el los las y del al con por para una se su sus como más fue "
    "il lo gli i e di del della dei delle che per un con su nel alla sono è "
    "het een van en op te voor met door werd niet zijn over om bij "
    "den det og af til en et er på for med som fra blev ved sin deres har".split()
)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-ÝÆØ\[{<«$%@_#]|[345]\d\d\b)|\n+")
# sentences that may run over several lines
_PROSE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\b(?=\w*\d)\w+\b|\d+")
_NEUTRAL = re.compile(r"^(?:[\w ]{2,20}(?: \| [\w ]{2,20})+|menu search login|© ?\w*|version #|back to start|zur startseite|reference #)$", re.I)

# What may fill a slot: marked tokens, numbers, capitalised words, names of variables, defaults (fixed values).
_BARE = r"[^\W\d_]+(?:_[^\W_]+)+|[a-z]{4,}[A-Z][A-Za-z]+"
_DEFAULT = r"(?i:null|nan|undefined|n/a|tb[cd]|none|unknown)(?!\w)|(?<![\w.,])(?:0{3,}|9{4,}|0{2}[./\-]0{2}[./\-]0{2,4})(?![\w.,]*\d)"
_NOUN = r"(?:amount|value|name|company|issuer|currency|date|year|period|figure|number|percentage)(?!\w)"
_MARK = re.compile(rf"{_WEAK.pattern}|(?<!\w)(?:{_BARE}|{_DEFAULT})(?!\w)")
_NOUNS = re.compile(_NOUN, re.I)
_PLAIN = re.compile(r"[^\W\d_]+")
_VISIBLE = re.compile(r"\S+")
#: Sentences of so many fixed words are a template for error pages too; shorter ones only have their slots aligned.
ALIGNED_WORDS = 4

HARD, SLOT, SEGMENT, ALIGNED, CONSTANT, SHORT = 0, 1, 2, 3, 4, 5
_ROWS = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("token", pa.string()), ("context", pa.string()), ("whole", pa.bool_())])
#: A segment stands in place of content where it makes up this share of its record.
PAGE_SHARE = 0.25
#: Constant filler has at most so many words, and this share of its occurrences (two at least) make up FILLER_WHOLE of a record.
FILLER_WORDS, FILLER_SHARE, FILLER_WHOLE = 7, 0.05, 0.1
#: A marked token so long may be told by its form alone; a longer one may be an aside, and what stands around or elsewhere in its place tells.
NAME_CHARS = 42
#: Marked tokens of nothing but units and references are no slots in constant words (fixed values).
NO_SLOT = r"(?i)^\W*(?:(?:see|in|of|and|note|table|page|figure|eur|usd|gbp|chf|dkk|sek|nok|m|mn|bn|million|millions|billion|thousand|unaudited|audited|restated)\b[\W#]*)+$"


def template_of(segment: str) -> str:
    """A segment with numbers and inner names masked, so that fillings of one template are equal."""
    first, _, rest = _DIGITS.sub("#", segment.strip()).partition(" ")
    return (first + " " + re.sub(r"\b[A-ZÀ-Ý]\w*(?:[ .\-/]+[A-ZÀ-Ý]\w*)*\.?", "N", rest)).strip().lower()


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def _is_filler(segment: str) -> bool:
    words = segment.lower().split()
    return len(words) >= 8 and FUNCTION_WORDS.isdisjoint(words) and sum(w[:1].isalpha() for w in words) >= 0.8 * len(words) and "|" not in segment


@lru_cache(200_000)
def _token(token: str) -> tuple[str, tuple[str, ...]]:
    """What a token fills a slot with (filled, marked, bare, noun), else '' and its fixed words."""
    if token[:1] in "12345678" and token.rstrip(".,;:)%").replace(".", "").replace(",", "").isdigit():
        return "filled", ()
    marks = [m.group().replace("\x1f", " ") for m in _MARK.finditer(token)]
    marks = [m for m in marks if not _FOOTNOTE.match(m) and not _MARKUP.match(m)]
    bare = token.strip(".,;:!?()\"'")
    if marks:
        return ("marked" if any(_WEAK.fullmatch(m) and m[0] != "«" for m in marks) else "bare"), ()
    if _NOUNS.fullmatch(bare):
        return "noun", ()
    if bare[:1].isupper() or any(c.isdigit() for c in bare):
        return "filled", ()
    return "", tuple(_PLAIN.findall(token.lower()))


def aligned(sentence: str) -> tuple[int, list[str], int] | None:
    """A sentence's template, and what stands between its fixed words, as 'place kind value': place is the number of words before it.

    Kinds: filled, marked, bare (name of a variable, default, quotation), noun (a common name of a variable alone) or both (a filling with such a noun);
    last comes the number of fixed words. It is given once more beside them; without fixed words nothing can be aligned.
    """
    if "[" in sentence or "{" in sentence or "<" in sentence or "«" in sentence:
        sentence = _WEAK.sub(lambda m: m.group().replace(" ", "\x1f"), sentence)
    words: list[str] = []
    found: dict[int, list[tuple[str, str]]] = {}
    for token, (kind, fixed) in zip(tokens := sentence.split(" "), map(_token, tokens)):
        if not kind:
            words += fixed
        elif (at := len(words)) in found:
            found[at].append((kind, token))
        else:
            found[at] = [(kind, token)]
    if not words:
        return None
    places = []
    for at, own in found.items():
        kinds = {k for k, _ in own}
        kind = own[0][0] if len(kinds) == 1 else "marked" if "marked" in kinds else "bare" if "bare" in kinds else "both"
        places.append(f"{at} {kind} {crc32(' '.join(v for _, v in own).encode())}")
    return _hash(" ".join(words)), [*places, f"{len(words)} all 0"], len(words)


def _word_before(text: str, end: int) -> list[str]:
    """The last word before a position, if there is one."""
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return [text[start:end]] if end else []


def _word_after(text: str, start: int) -> list[str]:
    return [m.group()] if (m := _VISIBLE.search(text, start)) else []


def scan_text(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(kind, key, token, context, whole) of whatever stands out in a text, and of every segment."""
    if any(first in text and pattern.search(text) for first, pattern in _STRONG):
        yield HARD, 0, "", "", False
    if any(c in text for c in "[{<«") or "XX" in text or "TB" in text or "TODO" in text:
        for m in _WEAK.finditer(text):
            token = m.group()
            if _MARKUP.match(token) or _FOOTNOTE.match(token):
                continue
            yield SLOT, 0, _DIGITS.sub("#", token), _DIGITS.sub("#", " ".join([*_word_before(text, m.start()), "□", *_word_after(text, m.end())])), False
    for x in _PROSE.split(text):
        if FUNCTION_WORDS.isdisjoint(x.lower().split()) and _is_filler(x):
            yield HARD, 0, "", "", False
            break
    for x in _SENTENCE.split(text):
        x = x.strip()
        if not x or _NEUTRAL.match(x):
            continue
        whole = len(x) >= PAGE_SHARE * len(text)
        a = aligned(x)
        if a and a[2] >= ALIGNED_WORDS:
            yield ALIGNED, a[0], "", "|".join(a[1]), whole
        else:
            yield SEGMENT, _hash(template_of(x)), "", "", whole
            if a:
                yield SHORT, a[0], "", "|".join(a[1]), whole
        if x.count(" ") < FILLER_WORDS and len(x) > 3 and not any(map(str.isdigit, x)):
            yield CONSTANT, _hash(x.lower()), "", "", len(x) >= FILLER_WHOLE * len(text)


def residue(texts: DataFrame, id_col: str = "doc_id", source_col: str = "source", min_records: int = 5, whole_share: float = 0.25, fixed_share: float = 0.8) -> DataFrame:
    """doc_id of each record that is or holds template residue, filler or a message in place of content."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, *x) for i, s, t in zip(*(c.to_pylist() for c in batch.columns)) for x in scan_text(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ROWS), _ROWS)], schema=_ROWS)

    source = F.xxhash64(source_col) if source_col in texts.columns else F.monotonically_increasing_id()
    seen = texts.where(F.length("text") > 0).select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), "text").mapInArrow(
        scan, "doc_id long, source long, kind int, key long, token string, context string, whole boolean"
    )
    return judge(cut(seen), min_records, whole_share, fixed_share)  # read several times below


def judge(seen: DataFrame, min_records: int, whole_share: float, fixed_share: float) -> DataFrame:
    hard = seen.where(F.col("kind") == HARD).select("doc_id")
    slots = seen.where(F.col("kind") == SLOT).select("doc_id", "token", "context")
    contexts = slots.groupBy("token", "context").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    # in constant words the form tells, at every count: a slot unless it is empty, quotes a value or is a unit or reference
    named = (F.length("token") <= NAME_CHARS) & F.col("token").rlike(r"[A-Z]{2}|\w \w|_|XX") & ~F.col("token").rlike(NO_SLOT)
    slot_keys = contexts.where((F.col("top") < F.col("n") * fixed_share) | named).select("token")
    segments = seen.where(F.col("kind").isin(SEGMENT, ALIGNED, CONSTANT)).select("doc_id", "source", "kind", "key", "whole")
    counted = segments.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("w"), (F.min("source") < F.max("source")).alias("spread")).where((F.col("n") >= 3) & F.col("spread"))
    # the least share that is likely for so many of so few (95 %, by Wilson): 3 of 3 pass, 3 of 6 don't
    z, n, share = 1.96, F.col("n"), F.col("w") / F.col("n")
    likely = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    filler = (F.col("kind") == CONSTANT) & (n >= min_records) & (F.col("w") >= F.greatest(F.lit(2), F.col("n") * FILLER_SHARE))
    pages = counted.where(filler | ((F.col("kind") != CONSTANT) & (likely >= whole_share))).select("kind", "key")
    return hard.unionByName(slots.join(slot_keys, "token").select("doc_id")).unionByName(segments.join(pages, ["kind", "key"]).select("doc_id")).unionByName(unfilled(seen, min_records)).distinct()


def unfilled(seen: DataFrame, min_records: int, slot_share: float = 0.9) -> DataFrame:
    """doc_id of the records whose sentence has no value where others of its template have one."""
    sentences = seen.where(F.col("kind").isin(ALIGNED, SHORT)).select("doc_id", "key", "context")
    places = sentences.select("doc_id", "key", F.explode(F.split("context", r"\|")).alias("p")).select(
        "doc_id", "key", F.split_part("p", F.lit(" "), F.lit(1)).cast("int").alias("place"), F.split_part("p", F.lit(" "), F.lit(2)).alias("what"), F.split_part("p", F.lit(" "), F.lit(3)).cast("long").alias("value")
    )
    of = lambda *kinds: F.count_if(F.col("what").isin(*kinds))
    value = F.when(F.col("what") == "filled", F.col("value"))
    each = cut(
        places.groupBy("key", "place").agg(of("filled").alias("filled"), of("both").alias("both"), of("marked", "bare", "noun").alias("open"), of("all").alias("records"), (F.min(value) < F.max(value)).alias("vary"))
        .where((F.col("filled") > 0) | (F.col("records") > 0))
    )
    ends = each.where("records > 1").select("key", "records", F.col("place").alias("words"))
    counted = each.where("filled > 0").drop("records").join(ends, "key")
    usual = (F.col("filled") >= min_records) & F.col("vary")
    mostly = usual & (F.col("filled") + F.col("open") >= F.col("records") * slot_share) & (F.col("filled") >= F.col("records") / 2) & (F.col("both") == 0)
    # at either end of a sentence nothing is missed: lines end and begin there
    inner = (F.col("place") > 0) & (F.col("place") < F.col("words"))
    slots = counted.select("key", "place", "open", "filled", usual.alias("usual"), mostly.alias("mostly"), (mostly & inner & (F.col("filled") + F.col("open") < F.col("records")) & (F.col("filled") >= 2 * min_records)).alias("some_blank"))
    told = F.when(F.col("what") == "marked", F.col("filled") > 0).when(F.col("what") == "bare", F.col("usual")).otherwise(F.col("mostly"))
    named = places.where(F.col("what").isin("marked", "bare", "noun")).join(slots.where((F.col("open") > 0) & (F.col("filled") > 0)), ["key", "place"]).where(told)
    blank = sentences.join(slots.where("some_blank").select("key", "place"), "key").where(~F.concat(F.lit("|"), "context").contains(F.concat(F.lit("|"), F.col("place").cast("string"), F.lit(" "))))
    return named.select("doc_id").unionByName(blank.select("doc_id"))
