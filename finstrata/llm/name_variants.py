"""Spellings of one company linked: typos, abbreviations, moved parts, short names, legal forms.

Every distinct name is read into its own word (core), its line of business and its legal form. Cores
meet in blocks of their suffixes (and of their beginning), within a line of business; a block that is
still too common is split by the core's other end, where longer suffixes of the same core take over. Whatever is within one edit meets
besides in blocks of the core without one letter, which no size splits. Pairs that meet are compared by the ratio of their longest common
subsequence and by edits. Links are closed to entities by propagating the smallest label.

Edge cases: null names are left out; names without letters are entities of their own; a name given many
times is one name; a short name that would fit several companies is linked to none of them; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finstrata.llm.confusions import fold_str
from finstrata.llm.symmetric_delete import deletes, weighted_distance
from finstrata.runtime import cut

# Legal forms, written without points and slashes.
LEGAL = frozenset("plc se nv as ag inc ltd spa sa incorporated limited gmbh kgaa kg bv ab oyj asa llc llp corp corporation co srl sarl sas".split())
LEGAL_PHRASES = re.compile(
    r"\b(?:societa per azioni|societas europaea|societe anonyme|sociedad anonima|public limited company|naamloze vennootschap|besloten vennootschap|(?:a[ck]tien?)gesellschaft|aktieselskab(?:et)?|limited liability company)\b"
)
# Words for lines of business, and words that say nothing about the line.
LINES = "mining retail chemicals mobility pharma foods packaging networks engineering energy water insurance media finance property logistics materials textiles shipping timber".split()
QUALIFIERS = "group holdings industries technologies international associates brothers manufacturing services sons and company".split()
_ASIDE = frozenset("group parent consolidated holding company".split())
_ALIAS = re.compile(r"^([^\W\d_][^\W\d_A-ZÀ-ÖØ-Þ]{3,})([A-ZÀ-ÖØ-Þ][a-zß-ÿ]{2})$")
#: A word that goes with this many others, in this many names, is no company's own word.
COMMON_WORD = 20
MIN_SUFFIX, HEAD, MAX_BLOCK = 3, 4, 50
MIN_LCS = 0.85


def without_accents(text: str) -> str:
    text = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("Æ", "Ae")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def core_key(core: str) -> str:
    """A core in which an umlaut, its two-letter spelling and the bare vowel are the same."""
    return re.sub(r"([aou])e", r"\1", core)


def tokens_of(name: str) -> list[str]:
    low = re.sub(r"[.'’]", "", without_accents(name).lower()).replace("/", "")
    low = LEGAL_PHRASES.sub(" ", re.sub(r"[&+]", " and ", low))
    return re.findall(r"[^\W_]+", low)


def generic_word(token: str, vocabulary: list[str]) -> str | None:
    """The common word that a token is, abbreviates, extends or misspells."""
    if token in vocabulary:
        return token
    if len(token) >= 4:
        near = [w for w in vocabulary if abs(len(w) - len(token)) <= 1 and weighted_distance(token, w, 1.0) <= 1.0]
        if near:
            return near[0]
    longer = [w for w in vocabulary if len(w) >= 5 and token.startswith(w)]
    if longer:
        return max(longer, key=len)
    if 2 <= len(token) <= 7:
        for fits in (str.startswith, _in_order):
            found = sorted({w for w in vocabulary if len(w) > len(token) and w[0] == token[0] and fits(w, token)})
            if len(found) == 1 or (found and len(token) >= 3):
                return found[0]
    return None


def _in_order(word: str, letters: str) -> bool:
    rest = iter(word)
    return all(c in rest for c in letters)


def aside_of(name: str, vocabulary: list[str]) -> str | None:
    """What a name gives in brackets as another name of its own: no legal form and no common word."""
    for inner in re.findall(r"\(([^()]*)\)", name):
        words = [w for w in tokens_of(inner) if w not in LEGAL and w not in _ASIDE]
        if words and any(generic_word(w, vocabulary) is None for w in words) and re.search(r"[^\W\d_]{3}", inner):
            return inner.strip()
    return None


def initials_of(name: str, vocabulary: list[str]) -> str:
    """The first letters of a name's words without legal forms; of a name that is such letters itself, these."""
    words = [w for w in tokens_of(re.sub(r"\([^)]*\)", " ", name)) if w not in LEGAL]
    if len(words) == 1:
        raw = re.findall(r"[^\W\d_]+", re.sub(r"\b[A-Z][A-Za-z]?[./]\S*", " ", name))
        own = [w for w in raw if w.lower() == words[0]]
        return words[0] if own and own[0].isupper() and 3 <= len(own[0]) <= 6 and generic_word(words[0], vocabulary) is None else ""
    return "".join(w[0] for w in words if w not in ("and", "the", "of"))


def read_name(name: str, vocabulary: list[str]) -> tuple[str, str, bool, str]:
    """(core, line of business, is a short name, core as typed) of a typed company name. Own words count in any order."""
    outside = re.sub(r"\(([^)]*)\)", " ", name)
    words = [w for w in tokens_of(outside) if w not in LEGAL]
    raw = [w for w in re.findall(r"[^\W\d_]+", outside) if _ALIAS.match(w)]
    if raw and len(words) == 1:
        core, line = _ALIAS.match(raw[0]).groups()
        core = without_accents(core).lower()
        return core, generic_word(without_accents(line).lower(), vocabulary) or line.lower(), True, core
    generic = {w: generic_word(w, vocabulary) for w in words}
    own = [w for w in words if generic[w] is None and w not in _ASIDE]
    if not own and words:
        own = [max(words, key=len)]
    lines = sorted({g for w, g in generic.items() if g and w not in own and g not in QUALIFIERS})
    core = " ".join(sorted(own))
    return core_key(core), " ".join(lines), False, core


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the lengths of both."""
    if not a or not b:
        return 0.0
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return 2 * last[-1] / (len(a) + len(b))


def common_words(names: DataFrame) -> list[str]:
    """Words of many names that go with many different words. At most 5,000 times the words of a name, by the threshold on their share."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("name"), r"[.'’/]", ""), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    listed = names.select(F.transform(words, lambda w: w).alias("words")).withColumn("w", F.explode("words"))
    least = F.greatest(F.lit(COMMON_WORD), names.agg((F.count(F.lit(1)) / 5000).alias("n")).select("n").first()[0] * F.lit(1.0))
    frequent = listed.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    partners = listed.join(F.broadcast(frequent.select("w")), "w").select("w", F.explode("words").alias("x")).groupBy("w").agg(F.approx_count_distinct("x").alias("partners"))
    return sorted(without_accents(r.w) for r in partners.where(F.col("partners") >= COMMON_WORD).collect() if r.w not in LEGAL)


def read_names(names: DataFrame) -> DataFrame:
    """name -> name, core, line, alias, typed, initials, is_initials, and the core, line and alias of the other name it gives in brackets."""
    vocabulary = LINES + QUALIFIERS
    vocabulary = vocabulary + [w for w in common_words(names) if generic_word(w, vocabulary) is None and not LEGAL_PHRASES.search(w) and w not in LEGAL_WORDS]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n in batch["name"]:
                other = aside_of(n, vocabulary)
                aka = read_name(other, vocabulary)[:3] if other else (None, None, None)
                initials = initials_of(n, vocabulary)
                rows.append((n, *read_name(n, vocabulary), initials, bool(initials) and [w for w in tokens_of(n) if w not in LEGAL] == [initials], *aka))
            yield pd.DataFrame(rows, columns=_READ_COLUMNS)

    return names.mapInPandas(read, "name string, core string, line string, alias boolean, typed string, initials string, is_initials boolean, aka_core string, aka_line string, aka_alias boolean")


_READ_COLUMNS = ["name", "core", "line", "alias", "typed", "initials", "is_initials", "aka_core", "aka_line", "aka_alias"]
LEGAL_WORDS = frozenset("societa per azioni societas europaea societe anonyme public limited company naamloze vennootschap aktiengesellschaft aktieselskab".split())


def _suffixes(forms: DataFrame) -> DataFrame:
    """Each form with every suffix of its core that is long enough."""
    n = F.length("core")
    return forms.select(
        "form", "core", "line",
        F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - MIN_SUFFIX + 1)), lambda i: F.substring(F.col("core"), i, F.lit(1000)))).alias("suffix"),
    )


def variant_links(forms: DataFrame) -> DataFrame:
    """a, b: forms (form, core, line, alias, typed) of the same line whose cores are one misspelling apart, or a short name and its company."""
    full = forms.where(~F.col("alias"))
    # a core whose last letters are mistyped has no suffix in common with the right one: its beginning stands in
    headed = full.select("form", "core", "line", F.concat(F.lit("^"), F.substring("core", 1, HEAD)).alias("suffix"))
    indexed = _suffixes(full).unionByName(headed).distinct()
    sizes = indexed.groupBy("suffix", "line").agg(F.count(F.lit(1)).alias("n"))
    # too common even within a line of business: the block is split once more, by the other end of the core
    other_end = F.when(F.col("suffix").startswith("^"), F.substring("core", -2, 2)).otherwise(F.substring("core", 1, 3))
    keyed = indexed.join(sizes, ["suffix", "line"]).select(
        "form", "core", F.concat_ws("|", "line", "suffix", F.when(F.col("n") > MAX_BLOCK, other_end)).alias("block")
    )
    # and what is one edit, or confusions only, apart meets at every size of the blocks: by what is left without one letter, or folded

    @F.pandas_udf("array<string>")
    def edits(cores: pd.Series) -> pd.Series:
        return cores.map(lambda c: sorted(deletes(c, 1)) + ["=" + fold_str(c)])

    keyed = keyed.unionByName(full.where(F.length("core") >= 5).select("form", "core", "line", F.explode(edits("core")).alias("edit")).select("form", "core", F.concat_ws("|", "line", F.lit("~"), "edit").alias("block")))
    left, right = keyed.select(F.col("form").alias("a"), F.col("core").alias("core_a"), "block"), keyed.select(F.col("form").alias("b"), F.col("core").alias("core_b"), "block")
    near = (F.abs(F.length("core_a") - F.length("core_b")) <= 1) & (F.col("a") < F.col("b"))
    pairs = left.join(right, "block").where(near).select("a", "b", "core_a", "core_b").distinct()

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([min(len(x), len(y)) >= 5 and lcs_ratio(x, y) >= MIN_LCS and weighted_distance(x, y, 1.0) <= 1.0 for x, y in zip(a, b)], dtype=bool)

    close = alike
    misspelt = pairs.where(alike("core_a", "core_b")).select("a", "b")
    heads = full.select("form", "line", F.explode(F.transform(F.array(*map(F.lit, (2, 3, 4))), lambda k: F.substring(F.col("typed"), F.lit(1), F.length("typed") - k))).alias("core"))
    short = forms.where("alias").select(F.col("form").alias("a"), "core", "line").join(heads, ["core", "line"]).join(full.select(F.col("form").alias("_f"), F.col("core").alias("_c")), F.col("form") == F.col("_f"))
    # spellings of one company may fit alike: they have one core, or one of them is linked to the other anyway
    single = short.groupBy("a").agg(F.min("form").alias("b"), F.min("_c").alias("c0"), F.max("_c").alias("c1")).where(close("c0", "c1")).select("a", "b")
    return misspelt.unionByName(single)


def initial_links(read: DataFrame) -> DataFrame:
    """a, b: a name that is the initials of one company's words, and that company; of several companies', it is linked to none."""
    own = read.where("is_initials").select(F.col("form").alias("a"), "initials").distinct()
    full = read.where(~F.col("is_initials") & (F.length("initials") >= 3)).select("initials", F.col("form").alias("b"), "core", "line").distinct()
    met = own.join(full, "initials").groupBy("a").agg(F.min("b").alias("b"), F.min("core").alias("c0"), F.max("core").alias("c1"), F.min("line").alias("l0"), F.max("line").alias("l1"))
    return met.where("c0 = c1 AND l0 = l1").select("a", "b")


def connected(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, label: the smallest node of each component, by propagating labels until none changes."""
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"))
    for _ in range(most_rounds):
        offered = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("best"))
        # and the label of one's label: halves the path each round
        jumped = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        moved = cut(
            jumped.join(offered, jumped["node"] == offered["x"], "left")
            .select("node", F.least("label", F.coalesce("best", "label"), F.coalesce("further", "label")).alias("new"), F.col("label").alias("old"))
        )
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where(F.col("new") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError(f"components not settled after {most_rounds} rounds")


def company_entities(documents: DataFrame, name_col: str = "company_name") -> DataFrame:
    """name, entity: every distinct name with the label of the company it means."""
    names = documents.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("name")).distinct()
    form = F.xxhash64("core", "line", "alias")
    read = cut(read_names(names.repartition(names.sparkSession.sparkContext.defaultParallelism)).withColumn("form", F.when(F.length("core") > 0, form).otherwise(F.xxhash64("name"))))
    forms = read.where(F.length("core") > 0).groupBy("form", "core", "line", "alias").agg(F.min("typed").alias("typed"))
    # another name given in brackets is linked where it stands alone as well
    bracketed = read.where(F.length("aka_core") > 0).select(F.col("form").alias("a"), F.xxhash64("aka_core", "aka_line", "aka_alias").alias("b")).where("a <> b").distinct()
    bracketed = bracketed.join(forms.select(F.col("form").alias("b")), "b", "left_semi").select("a", "b")
    labels = connected(variant_links(forms).unionByName(bracketed).unionByName(initial_links(read)))
    return read.join(labels, read["form"] == labels["node"], "left").select("name", F.coalesce("label", "form").alias("entity"))


def variant_pairs(documents: DataFrame, name_col: str = "company_name") -> DataFrame:
    """name_a < name_b (by code point): each pair of different names of one company."""
    entities = company_entities(documents, name_col)
    a, b = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
