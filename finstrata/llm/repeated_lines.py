"""Lines repeated across the pages of one source, mined as frequent sequences of line identifiers.

PrefixSpan over a table: a page is a sequence of line keys, a source (document_id) a database of
sequences. Level 1 counts each key once a page. The pages are then reduced to their frequent keys, equal
sequences of one source are counted once with their number, and each level joins what is left behind a
prefix with the frequent prefixes it grows to, until none is left. Lines that always stand one after the
other grow as one, so that a block of n lines is one pattern and not 2^n. Reported are the closed
patterns: those that no longer one has the same support as. What is deleted are the occurrences of their
members, single lines included.

Edge cases: a null or empty text has no lines but counts as a page of its source; a null document_id
is a source of its own; a page given twice counts twice; lines with fewer than min_letters letters are
never keys, so they are never removed. Columns other than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.llm.confusions import fold
from finstrata.runtime import cut

#: Pages of one source that share a copy of its frequent keys: a source of any size is spread over its copies.
PAGES_A_COPY = 512
#: Pages without a number are dealt to so many copies by the hash of their id.
UNNUMBERED = 4096


def line_keys(pages: DataFrame, min_letters: int = 12) -> DataFrame:
    """page_id, source, copy and lines: array of (line_no, key, other) for lines long enough to count.

    key is equal for lines that differ in case, white space, confusable characters or the page's own
    number; other is the key with that number kept, null where it doesn't occur. source is the document_id, told from null.
    """
    number = F.col("page_number")
    copy = F.coalesce(F.floor(number / PAGES_A_COPY).cast("long"), -1 - F.pmod(F.xxhash64("id"), F.lit(UNNUMBERED)))
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = pages.select(
        F.col("id").alias("page_id"), F.coalesce(F.concat(F.lit("="), "document_id"), F.lit("")).alias("source"), copy.alias("copy"),
        F.regexp_replace(text, r"[^\p{L}\n]+", "").alias("letters"), fold(text).alias("folded"), fold(number.cast("string")).alias("number"),
    )
    has_own = F.coalesce(F.contains("folded", "number"), F.lit(False))
    # the number comes first in the pattern, so that most places are passed over at its first character
    alone = F.concat("number", F.lit(r"(?<![\p{L}\p{N}]"), "number", F.lit(r")(?![\p{L}\p{N}])"))
    split = lambda c: F.split(c, "\n", -1)
    squeeze = lambda c: split(F.regexp_replace(c, r"[^\S\n]+", ""))
    raw = folded.select(
        "page_id", "source", "copy", split("letters").alias("letters"), squeeze(F.col("folded")).alias("plain"),
        F.when(has_own, squeeze(F.regexp_replace("folded", alone, F.lit("#")))).alias("own"),
    )

    def line(letters: Column, i: Column) -> Column:
        plain = F.get("plain", i)
        own = F.coalesce(F.get("own", i), plain)
        return F.struct((i + 1).cast("long").alias("line_no"), F.when(F.length(letters) >= min_letters, F.xxhash64(own)).alias("key"), F.when(own != plain, F.xxhash64(plain)).alias("other"))

    return raw.select("page_id", "source", "copy", F.filter(F.transform("letters", line), lambda x: x["key"].isNotNull()).alias("lines"))


def frequent_lines(keyed: DataFrame, min_pages: int = 4, min_share: float = 1 / 3) -> DataFrame:
    """Level 1: source, key, support, pages of each key on enough pages of its source."""
    once = F.array_distinct(F.flatten(F.transform("lines", lambda x: F.array_compact(F.array(x["key"], x["other"])))))
    supports = (
        keyed.select("source", F.explode(once).alias("key"))
        .groupBy("source", "key").agg(F.count(F.lit(1)).alias("support"))
        .where(F.col("support") >= min_pages)
    )
    counts = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    return supports.join(counts, "source").where(F.col("support") >= F.col("pages") * F.lit(min_share) - 1e-9)


def _with_sets(paged: DataFrame, keys: DataFrame) -> DataFrame:
    """paged (source, copy, ...) with `wanted`, the array of its source's keys; pages of sources without any are left out.

    A source has at most its lines a page / min_share of them, whatever its size; each of its copies gets them once.
    """
    sets = keys.groupBy("source").agg(F.collect_set("key").alias("wanted"))
    return paged.join(paged.select("source", "copy").distinct().join(sets, "source"), ["source", "copy"])


def _one_of(x: Column) -> Column:
    """A line's wanted key: the one without the page's number first; null if neither is wanted."""
    return F.when(F.array_contains("wanted", x["key"]), x["key"]).when(F.array_contains("wanted", x["other"]), x["other"])


def reduced(keyed: DataFrame, frequent: DataFrame) -> DataFrame:
    """page_id, source, copy, lines of the pages with frequent lines, reduced to those lines; items: their keys in page order."""
    return _with_sets(keyed, frequent.select("source", "key")).select(
        "page_id", "source", "copy", F.filter("lines", lambda x: _one_of(x).isNotNull()).alias("lines"), F.filter(F.transform("lines", _one_of), lambda k: k.isNotNull()).alias("items")
    ).where(F.size("items") > 0)


def _blocks(database: DataFrame) -> DataFrame:
    """database (source, items, n) with `blocks`: its items as runs (head, keys) that never stand apart."""
    at = database.select("source", "n", F.posexplode("items").alias("i", "x"), F.col("items"))
    followed = at.select("source", "n", "x", F.get("items", F.col("i") + 1).alias("y"))
    seen = followed.groupBy("source", "x").agg(F.sum("n").alias("n_x"))
    pairs = followed.where(F.col("y").isNotNull()).groupBy("source", "x", "y").agg(F.sum("n").alias("n_xy"))
    glued = (
        pairs.join(seen, ["source", "x"]).join(seen.select("source", F.col("x").alias("y"), F.col("n_x").alias("n_y")), ["source", "y"])
        .where((F.col("n_xy") == F.col("n_x")) & (F.col("n_xy") == F.col("n_y")))
    )
    tails = glued.groupBy("source").agg(F.collect_set("y").alias("tails"))
    inner = F.coalesce("tails", F.expr("array()").cast("array<bigint>"))
    heads = database.join(tails, "source", "left").withColumn("at", F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: ~F.array_contains(inner, F.get("items", i))))
    run = lambda p, k: F.struct(F.get("items", p).alias("head"), F.slice("items", p + 1, F.coalesce(F.get("at", k + 1), F.size("items")) - p).alias("keys"))
    return heads.select("source", "n", F.transform("at", run).alias("blocks"))


def mine(database: DataFrame, pages: DataFrame, min_pages: int, min_share: float, max_length: int | None = None) -> DataFrame:
    """source, sequence (keys), support: the closed patterns of database (source, items, n) over pages (source, pages).

    max_length: grow patterns to so many blocks only.
    """
    least = F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * F.lit(min_share) - 1e-9))
    blocks = cut(_blocks(database).join(pages.select("source", least.alias("least")), "source"))
    keys_of = blocks.select("source", F.explode("blocks").alias("b")).select("source", "b.head", "b.keys").distinct()
    grown = blocks.select(
        "source", "least", "n", F.expr("cast(array() as array<bigint>)").alias("prefix"), F.transform("blocks", lambda b: b["head"]).alias("rest")
    )
    levels: list[DataFrame] = []
    while max_length is None or len(levels) < max_length:
        nexts = grown.select("source", "least", "n", "prefix", "rest", F.explode(F.array_distinct("rest")).alias("next")).select(
            "source", "least", "n", F.concat("prefix", F.array("next")).alias("prefix"), F.expr("slice(rest, array_position(rest, next) + 1, size(rest))").alias("rest")
        ).groupBy("source", "least", "prefix", "rest").agg(F.sum("n").alias("n"))
        level = nexts.groupBy("source", "least", "prefix").agg(F.sum("n").alias("support")).where("support >= least").drop("least")
        grown = cut(nexts.join(level, ["source", "prefix"]))
        if grown.isEmpty():
            break
        levels.append(grown.select("source", "prefix", "support").distinct())
    if not levels:
        return blocks.select("source", F.expr("cast(array() as array<bigint>)").alias("sequence"), F.lit(0).cast("long").alias("support")).where(F.lit(False))
    closed = None
    for k, level in enumerate(levels):
        if k + 1 < len(levels):  # a pattern with the support of a longer one says nothing more
            shorter = levels[k + 1].select("source", "support", F.explode(F.transform(F.sequence(F.lit(0), F.lit(k + 1)), lambda i: F.filter("prefix", lambda x, j: j != i))).alias("prefix"))
            level = level.join(shorter.distinct(), ["source", "prefix", "support"], "left_anti")
        closed = level if closed is None else closed.unionByName(level)
    pattern = closed.select("source", "support", "prefix", F.posexplode("prefix").alias("i", "head")).join(keys_of, ["source", "head"])
    return pattern.groupBy("source", "prefix", "support").agg(F.array_sort(F.collect_list(F.struct("i", "keys"))).alias("parts")).select(
        "source", F.flatten(F.transform("parts", lambda x: x["keys"])).alias("sequence"), "support"
    )


def _patterns(hit: DataFrame, frequent: DataFrame, min_pages: int, min_share: float, max_length: int | None = None) -> DataFrame:
    """Patterns of the reduced pages, and the lines whose own support is above that of every pattern they are in."""
    database = hit.groupBy("source", "items").agg(F.count(F.lit(1)).alias("n"))
    found = mine(database, frequent.select("source", "pages").distinct(), min_pages, min_share, max_length)
    most = found.select("source", F.explode("sequence").alias("key"), "support").groupBy("source", "key").agg(F.max("support").alias("most"))
    # a line that counts with and without a number may have more pages than the mined key of it
    alone = frequent.join(most, ["source", "key"], "left").where(F.col("most").isNull() | (F.col("support") > F.col("most")))
    return found.unionByName(alone.select("source", F.array("key").alias("sequence"), "support"))


def _marked(pages: DataFrame, min_letters: int, min_pages: int, min_share: float) -> DataFrame:
    """page_id, drop: the numbers of the lines to delete, of each page that has any."""
    keyed = cut(line_keys(pages, min_letters))  # read twice below: folding the texts costs more than writing their keys
    frequent = cut(frequent_lines(keyed, min_pages, min_share))
    hit = cut(reduced(keyed, frequent))
    members = _patterns(hit, frequent, min_pages, min_share).select("source", F.explode("sequence").alias("key")).distinct()
    bad = F.filter("lines", lambda x: _one_of(x).isNotNull())
    return _with_sets(hit, members).select("page_id", F.transform(bad, lambda x: x["line_no"]).alias("drop")).where(F.size("drop") > 0)


def repeated_line_occurrences(pages: DataFrame, min_letters: int = 12, min_pages: int = 4, min_share: float = 1 / 3) -> DataFrame:
    """page_id, line_no of each line that is a member of a frequent sequence of its source."""
    return _marked(pages, min_letters, min_pages, min_share).select("page_id", F.explode("drop").alias("line_no"))


def frequent_sequences(pages: DataFrame, min_letters: int = 12, min_pages: int = 4, min_share: float = 1 / 3, max_length: int | None = None) -> DataFrame:
    """document_id, sequence (keys in page order), support: the closed PrefixSpan patterns of every source."""
    keyed = cut(line_keys(pages, min_letters))
    frequent = cut(frequent_lines(keyed, min_pages, min_share))
    found = _patterns(cut(reduced(keyed, frequent)), frequent, min_pages, min_share, max_length)
    return found.select(F.when(F.col("source") != "", F.substring("source", 2, 2**31 - 1)).alias("document_id"), "sequence", "support")


def without_repeated_lines(pages: DataFrame, min_letters: int = 12, min_pages: int = 4, min_share: float = 1 / 3) -> DataFrame:
    """page_id and text of every page without its repeated lines; pages with none of them keep their text as it is."""
    # two texts under one id stay apart
    texts = pages.select("id", "text", F.xxhash64("text").alias("_h"))
    marked = _marked(pages.select(F.struct(F.col("id"), F.xxhash64("text").alias("h")).alias("id"), "document_id", "page_number", "text"), min_letters, min_pages, min_share)
    drop = marked.select(F.col("page_id.id").alias("_id"), F.col("page_id.h").alias("_p"), F.explode("drop").alias("no")).groupBy("_id", "_p").agg(F.collect_set("no").alias("drop"))
    joined = texts.join(drop, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_p")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("drop", (i + 1).cast("long")))
    return joined.select(F.col("id").alias("page_id"), F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
