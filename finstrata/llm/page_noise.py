"""Noise of scanned pages: words cut at line ends, misread characters, page numbers, running headers.

1. A frequency lexicon is counted over all pages (words cut at line ends are listed, but don't count).
2. Its words meet on the symmetric deletes of their folded spelling (confusions.fold): a rare word whose
   spelling is a confusion or two away from one that is far more frequent is a misreading of it. Where
   several words fit, the word before decides by bigram counts, else frequency.
3. One pass over the lines emits what may be noise: rare words, cut words, page numbers, and numbers with
   letters in them. Only the most frequent words are broadcast for that, at most MAX_FREQUENT by their
   share of all words; everything else is joined.

Edge cases: null or empty texts have no noise; a page number is only the page's own, so a null one is
never found; a hyphen before a blank line cuts nothing; repeated pages count twice and are each repaired.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.confusions import DIGIT_LOOKALIKES, fold
from finstrata.llm.symmetric_delete import CONFUSED, weighted_distance
from finstrata.runtime import cut

MAX_FREQUENT = 300_000
#: A right spelling is seen at least this often, and this many times as often as its misreading.
MIN_TARGET, MIN_RATIO, SHORT_RATIO = 10, 20, 100
#: Two confusions at most in one word.
MAX_COST = 2 * CONFUSED + 0.01
HYPHENS = "-­¬‐‑"
#: Marks that are never part of a compound.
SURE_CUTS = "­¬"
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_LINE_CUT = re.compile(rf"[{HYPHENS}][ \t]*\n[ \t]*")
_LEFT = re.compile(rf"([^\W_]+(?:-[^\W_]+)*)([{HYPHENS}])[ \t]*$")
_RIGHT = re.compile(r"[ \t]*([^\W_]+(?:-[^\W_]+)*)")
# Words for page, and for "of", in the languages of the pages.
_PAGE_LINE = re.compile(
    r"^[\W_]*(?:(?:page|pages|p|pag|pagina|página|pág|seite|s|side|blz|bladzijde)\b[\W_]*)?([0-9oOlIZzSsBbgq]{1,7})(?:\s*(?:/|\||of|von|sur|de|di|van|af|out of)\s*[0-9oOlIZzSsBbgq]{1,7})?[\W_]*$",
    re.I,
)
_DIGITS = str.maketrans({k: v for k, v in DIGIT_LOOKALIKES.items()})
_NUMBER_LIKE = re.compile(r"^[0-9olizsbgq]+$")
#: An @ inside a word is read as a letter: the texts are searched with a letter in its place.
AT = "ª"
RARE, CUT, PAGE, NUMBER = "rare", "cut", "page_number", "number"


def is_misread_number(word: str) -> bool:
    """Digits with letters among them that look like digits."""
    digits = sum(c.isdigit() for c in word)
    return 0 < digits < len(word) and _NUMBER_LIKE.match(word) is not None and digits * 2 >= len(word)


def is_page_number(line: str, page_number: int | None) -> bool:
    m = _PAGE_LINE.match(line) if page_number is not None and 0 < len(line) <= 60 else None
    return bool(m) and any(c.isdigit() for c in line) and m[1].lower().translate(_DIGITS).lstrip("0") == str(page_number)


def without_cut_words(text: str) -> tuple[str, list[str]]:
    """A text without the words that a hyphen parts at the end of a line, a blank in their place; and those words in one."""
    kept, joined, at, end = [], [], 0, len(text)
    for m in _LINE_CUT.finditer(text):
        left, right = m.start(), m.end()
        while left > at and (text[left - 1].isalnum() or text[left - 1] == "-"):
            left -= 1
        while right < end and (text[right].isalnum() or text[right] == "-"):
            right += 1
        if left < m.start() and right > m.end():
            kept.append(text[at:left])
            joined.append(text[left : m.start()] + text[m.end() : right])
            at = right
    return (" ".join([*kept, text[at:]]) if kept else text), joined


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: every word of all texts in lower case. Words cut at a line end don't count: those seen only so have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch["text"]:
                whole, joined = without_cut_words(text.lower().replace("@", AT))
                seen.update(_WORD.findall(whole))
                for word in joined:
                    seen.setdefault(word, 0)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    return pages.where(F.length("text") > 0).select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _deletes(word_key):
    one = F.transform(F.sequence(F.lit(1), F.length(word_key)), lambda i: F.concat(F.substring(word_key, F.lit(1), i - 1), F.substring(word_key, i + 1, F.lit(1000))))
    return F.array_distinct(F.concat(F.array(word_key), one))


def misreadings(lexicon: DataFrame, max_cost: float = MAX_COST, min_ratio: float = MIN_RATIO) -> DataFrame:
    """word, repair, cost, n_repair: all acceptable repairs of words of the lexicon (word, n) that are misreadings."""
    words = lexicon.where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}")).withColumn("folded", fold(F.col("word")))
    # a word with a misreading or two keeps its length within two of the right one
    slots = words.select("word", "n", F.explode(_deletes(F.col("folded"))).alias("slot"))
    targets = slots.where((F.col("n") >= MIN_TARGET) & ~F.col("word").rlike(r"\d")).select(F.col("word").alias("repair"), F.col("n").alias("n_repair"), "slot")
    met = slots.join(targets, "slot").where(
        (F.col("n_repair") >= F.greatest(F.col("n"), F.lit(1)) * min_ratio) & (F.abs(F.length("word") - F.length("repair")) <= 2) & (F.col("word") != F.col("repair"))
    )

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(x, y, max_cost) for x, y in zip(a, b)], dtype="float64")

    pairs = met.select("word", "n", "repair", "n_repair").distinct().withColumn("cost", cost("word", "repair"))
    long_enough = (F.length("repair") >= 4) | ((F.col("cost") <= CONFUSED + 0.01) & (F.col("n_repair") >= F.greatest(F.col("n"), F.lit(1)) * SHORT_RATIO))
    return pairs.where((F.col("cost") <= max_cost) & long_enough).select("word", "repair", "cost", "n_repair")


def suspects(pages: DataFrame, frequent: set[str]) -> DataFrame:
    """page_id, line_no, kind, word, left, right, prev: everything on a line that may be noise."""
    shared = pages.sparkSession.sparkContext.broadcast(frequent)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            out = []
            for page_id, number, text in zip(batch["id"], batch["page_number"], batch["text"]):
                number = None if pd.isna(number) else int(number)
                lines = text.replace("@", AT).split("\n")
                carried = None
                for no, line in enumerate(lines, 1):
                    low = line.lower()
                    words = _WORD.findall(low)
                    if not words:
                        carried = None
                        continue
                    if len(line) <= 60 and is_page_number(line, number):
                        out.append((page_id, no, PAGE, None, None, None, None))
                    first = 0
                    if carried is not None:  # the rest of a word cut on the line before
                        first, carried = 1, None
                    last = len(words)
                    if line.rstrip()[-1:] in HYPHENS and no < len(lines):
                        m, r = _LEFT.search(line), _RIGHT.match(lines[no])
                        if m and r and not m[1].isdigit():
                            out.append((page_id, no, CUT, m[2], m[1], r[1], None))
                            carried, last = m[1], last - 1
                    if last - first > 0 and not known.issuperset(words[first:last]):
                        for k in range(first, last):
                            w = words[k]
                            if w not in known and not w.isdigit():
                                out.append((page_id, no, NUMBER if is_misread_number(w) else RARE, w, None, None, words[k - 1] if k else None))
            yield pd.DataFrame(out, columns=["page_id", "line_no", "kind", "word", "left", "right", "prev"])

    return pages.where(F.length("text") > 0).select("id", "page_number", "text").mapInPandas(
        look, "page_id string, line_no long, kind string, word string, left string, right string, prev string"
    )


def bigram_counts(pages: DataFrame, second: set[str]) -> DataFrame:
    """prev, repair, n of the word pairs whose second word is one of `second`."""
    shared = pages.sparkSession.sparkContext.broadcast(second)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for text in batch["text"]:
                words = _WORD.findall(text.lower().replace("@", AT))
                if not wanted.isdisjoint(words):
                    seen.update((a, b) for a, b in zip(words, words[1:]) if b in wanted)
            yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["prev", "repair", "n"])

    return pages.where(F.length("text") > 0).select("text").mapInPandas(count, "prev string, repair string, n long").groupBy("prev", "repair").agg(F.sum("n").alias("n"))


def cut_words(cuts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The cuts that split a word: not those at the hyphen of a compound. Adds joined, the word in one."""
    asked = cuts.withColumn("joined", F.concat("left", "right")).withColumn("compound", F.concat_ws("-", "left", "right"))
    n = lambda name: lexicon.select(F.col("word").alias(f"_{name}"), F.col("n").alias(f"n_{name}"))
    rated = (
        asked.join(n("joined"), F.lower("joined") == F.col("_joined"), "left")
        .join(n("compound"), F.lower("compound") == F.col("_compound"), "left")
        .join(n("right"), F.lower("right") == F.col("_right"), "left")
        .join(n("left"), F.lower("left") == F.col("_left"), "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    capital = F.substring("right", 1, 1).rlike(r"\p{Lu}") & ~F.substring("left", -1, 1).rlike(r"\p{Lu}")
    whole_parts = (zero("n_left") >= MIN_TARGET) & (zero("n_right") >= MIN_TARGET)
    return rated.where(
        F.col("word").isin(*SURE_CUTS)
        | ((zero("n_joined") > zero("n_compound")) & ~(capital & (zero("n_joined") == 0)))
        | ((zero("n_joined") == 0) & (zero("n_compound") == 0) & ~capital & ~whole_parts & ~F.substring("right", 1, 1).rlike(r"\d"))
    ).select(*cuts.columns, "joined")


def noise(pages: DataFrame, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """page_id, line_no, noise_kind (split_word, misread, page_number), word, repair of everything found."""
    lexicon = cut(word_counts(pages))
    wrong = cut(misreadings(lexicon))
    total = lexicon.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most total / least words can be seen `least` times
    least = max(5, -(-total // max_frequent))
    often = lexicon.where(F.col("n") >= least).join(wrong.select("word").distinct(), "word", "left_anti")
    frequent = {r.word for r in often.where(F.length("word") <= 60).select("word").collect() if not is_misread_number(r.word)}
    seen = cut(suspects(pages, frequent))
    rare = seen.where(F.col("kind").isin(RARE, NUMBER)).join(wrong, "word")
    several = wrong.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("word")
    options = wrong.join(several, "word").select("repair").distinct()
    # as many passes as it takes to hold no more than max_frequent words at a time; one, or none, in any corpus of words
    blocks = -(-options.count() // max_frequent)
    order = F.struct((-F.col("cost")).alias("c"), F.col("n_repair").alias("f"), "repair")
    pairs = None
    for block in range(blocks):
        seconds = {r.repair for r in options.where(F.pmod(F.xxhash64("repair"), F.lit(blocks)) == block).collect()}
        counted = bigram_counts(pages, seconds).withColumnRenamed("n", "n_pair")
        pairs = counted if pairs is None else pairs.unionByName(counted)
    if pairs is not None:
        rare = rare.join(pairs, ["prev", "repair"], "left")
        order = F.struct((-F.round(F.col("cost"), 0)).alias("c"), F.coalesce("n_pair", F.lit(0)).alias("p"), (-F.col("cost")).alias("d"), F.col("n_repair").alias("f"), "repair")
    misread = rare.groupBy("page_id", "line_no", "word").agg(F.max(order)["repair"].alias("repair"))
    numbers = seen.where(F.col("kind") == NUMBER).join(wrong.select("word").distinct(), "word", "left_anti").join(lexicon, "word", "left")
    numbers = numbers.select("page_id", "line_no", "word", F.coalesce("n", F.lit(0)).alias("n"), F.translate("word", "".join(DIGIT_LOOKALIKES), "".join(DIGIT_LOOKALIKES.values())).alias("repair"))
    numbers = numbers.join(lexicon.select(F.col("word").alias("repair"), F.col("n").alias("n_repair")), "repair", "left")
    # a code that the corpus uses often (B2B, CO2) is no number, unless it is far rarer than the number: then it is a misreading at any count
    rare_form = F.col("n") < F.greatest(F.lit(MIN_TARGET), F.lit(total // 100_000))
    numbers = numbers.where(rare_form | (F.col("n") * MIN_RATIO <= F.col("n_repair"))).select("page_id", "line_no", "word", "repair")
    cuts = cut_words(seen.where(F.col("kind") == CUT), lexicon)
    # a cut word may be misread as well: on the line that holds the wrong character
    spoilt = (
        cuts.withColumn("word", F.lower("joined")).join(wrong, "word").groupBy("page_id", "line_no", "word", "left").agg(F.max(F.struct((-F.col("cost")).alias("c"), F.col("n_repair").alias("f"), "repair"))["repair"].alias("repair"))
        .select("page_id", F.when(F.substring(F.col("word"), F.lit(1), F.length("left")) == F.substring(F.col("repair"), F.lit(1), F.length("left")), F.col("line_no") + 1).otherwise(F.col("line_no")).alias("line_no"), "word", "repair")
    )
    as_kind = lambda df, kind: df.select("page_id", "line_no", F.lit(kind).alias("noise_kind"), "word", "repair")
    return (
        as_kind(misread, "misread").unionByName(as_kind(numbers, "misread")).unionByName(as_kind(spoilt, "misread"))
        .unionByName(as_kind(cuts.select("page_id", "line_no", F.concat_ws("-", "left", "right").alias("word"), F.col("joined").alias("repair")), "split_word"))
        .unionByName(as_kind(seen.where(F.col("kind") == PAGE).withColumn("repair", F.lit("")), "page_number"))
    )


def noisy_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no, noise_kind of each line with noise."""
    return noise(pages).select("page_id", "line_no", "noise_kind").distinct()


def _match_case(repair: str, seen: str) -> str:
    return repair.upper() if seen.isupper() and len(seen) > 1 else repair[:1].upper() + repair[1:] if seen[:1].isupper() else repair


def readable(text: str, kinds: list[tuple[int, str, str, str]], headers: set[int]) -> str:
    """The page's text as paragraphs of one line each: words repaired and rejoined, page numbers and running headers left out."""
    by_line: dict[int, list[tuple[str, str, str]]] = {}
    for no, kind, word, repair in kinds:
        by_line.setdefault(no, []).append((kind, word, repair))
    done, run = [], ""
    for no, line in enumerate(text.split("\n"), 1):
        own = by_line.get(no, ())
        if no in headers or any(k == PAGE for k, _, _ in own):
            continue
        for kind, word, repair in own:
            if kind == "misread":
                shown = re.escape(word.replace(AT, "@"))
                line = re.sub(rf"(?<![^\W_]){shown}(?![^\W_])", lambda m: _match_case(repair, m.group()), line, flags=re.I)
        if not line.strip():
            if run:
                done.append(run)
            run = ""
            continue
        split = any(k == "split_word" for k, _, _ in own)
        piece = line.strip()
        glued = run.endswith("\x01") or (run[-1:] in tuple(HYPHENS) and run[-2:-1].isalnum())
        run = run + piece if glued else f"{run} {piece}" if run else piece
        run = run.replace("\x01", "")
        if split:
            run = run.rstrip(HYPHENS) + "\x01"
    if run:
        done.append(run)
    return "\n\n".join(done).replace("\x01", "")


def readable_pages(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """page_id and text of every page as continuous paragraphs. headers: page_id, line_no of running headers and other repeated lines."""
    found = noise(pages)
    # what is found on a page is no more than its lines and words
    fixes = found.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "noise_kind", "word", "repair")).alias("fixes"))
    running = headers.groupBy("page_id").agg(F.collect_set("line_no").alias("headers"))

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, fixes: pd.Series, headers: pd.Series) -> pd.Series:
        empty = lambda x: [] if x is None else x
        return pd.Series([
            readable(t, [(f["line_no"], f["noise_kind"], f["word"], f["repair"]) for f in empty(k)], set(empty(h))) if t else t for t, k, h in zip(texts, fixes, headers)
        ], dtype=object)

    joined = pages.select(F.col("id").alias("page_id"), "text").join(fixes, "page_id", "left").join(running, "page_id", "left")
    return joined.select("page_id", rebuilt("text", "fixes", "headers").alias("text"))
