"""Operator 9, quality rules: line-first cleaning in DataFrame functions only.

Every line is judged by itself (sentence end, navigation, boilerplate); lines that fail are removed; a
document that loses too large a share of its words is rejected, as is one that fails the base rules.
No shuffle: one projection over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, free_names, words_of

# What marks a line as navigation or boilerplate.
NAVIGATION = r"(?i)^\W*(home|menu|next|previous|prev|back|login|log in|sign in|sign up|search|share|skip to (main )?content|read more|contact us|about us|site ?map)\W*$"
BOILERPLATE = r"(?i)\b(lorem ipsum|enable javascript|uses? cookies|cookie policy|privacy policy|terms of (use|service)|subscribe to our|click here|all rights reserved)\b"
SENTENCE_END = ".!?:;…。！？"
CLOSING = "\"')]»”’" + BLANKS
SEPARATORS = "[|»>•·]"
SYMBOLS = "#*$%&|<>"
#: Code points a navigation or boilerplate line has at most: longer lines are prose that mentions such a phrase.
SHORT_LINE = 200


def let(value: Column, body) -> Column:
    """body(value), with value computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, n: int = 5) -> Column:
    """How many words stand in windows of n words that occur twice or more in the array.

    Words are hashed once and windows built from pairs of hashes. A document whose window hashes are all distinct
    has none. Else 33 bits of every window's hash and its position share a long; sorted, equal neighbours are the
    only windows that can repeat. Those few are compared by their whole hash, and the union of the repeats' spans
    is summed over their sorted positions: n log n in the document's length.
    """
    if n != 5:
        raise ValueError("windows have five words")
    both = lambda a, b: F.zip_with(F.slice(a, 1, F.size(b)), b, lambda x, y: F.xxhash64(x, y))
    tail = lambda a, k: F.slice(a, k + 1, F.size(a) - k)
    mask = (1 << 31) - 1

    def hashes(ids: Column) -> Column:
        return let(let(both(ids, tail(ids, 1)), lambda h2: both(h2, tail(h2, 2))), lambda h4: both(h4, tail(ids, 4)))

    def possible(p: Column) -> Column:
        same = lambda x, y: F.when(F.shiftright(x, 31) == F.shiftright(y, 31), F.array(x, y))
        pairs = F.filter(F.zip_with(F.slice(p, 1, F.size(p) - 1), tail(p, 1), same), lambda x: x.isNotNull())
        return F.array_distinct(F.transform(F.flatten(pairs), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")))

    def repeats(s: Column) -> Column:
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        same = lambda x, y: F.when(x["h"] == y["h"], x["i"])
        before, after = F.zip_with(s, F.concat(none, F.slice(s, 1, F.size(s) - 1)), same), F.zip_with(s, F.concat(tail(s, 1), none), same)
        return F.sort_array(F.filter(F.zip_with(before, after, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, tail(p, 1), lambda x, y: F.least(F.coalesce(y - x, F.lit(n)), F.lit(n)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 31).bitwiseOR(i.cast("long"))))
        whole = lambda at: F.sort_array(F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        found = let(let(packed, possible), lambda at: let(whole(at), lambda s: let(repeats(s), covered)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    ids = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) > n, let(let(ids, hashes), count)).otherwise(F.lit(0).cast("long"))


def line_fails(line: Column, short_line: int) -> Column:
    """True for a line with a word and without a sentence end, a navigation or boilerplate line of at most short_line code points, or a row of separated items."""
    body = F.rtrim(line, F.lit(CLOSING))
    no_end = ~F.substring(body, -1, 1).isin(*SENTENCE_END)
    short = (F.length(line) <= short_line) & (line.rlike(NAVIGATION) | line.rlike(BOILERPLATE))
    row = line.rlike(SEPARATORS) & (F.regexp_count(line, F.lit(SEPARATORS)) * 3 >= F.size(words_of(line)))
    return (F.trim(line, F.lit(BLANKS)) != "") & (no_end | short | row)


def quality_rules(docs: DataFrame, *, text: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeated: int = 20, short_line: int = SHORT_LINE) -> DataFrame:
    """The input's columns with: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    n_lost_words (long), cleaned (the text without failing lines) and kept.

    A document is kept if it passes the base rules and loses at most max_lost of its words with its failing
    lines. Lines of more than short_line code points are prose that mentions a phrase, not navigation or boilerplate. Null text
    counts as empty: no words, base_failed. Rows are judged one by one, so repeated rows give
    repeated results; whole texts are judged, however long; an empty table gives none. Other columns pass through; those with the names of new columns are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    fails = lambda line: line_fails(line, short_line)
    plain = body
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    words, lines = free_names(docs, "_words", "_lines")
    out = docs.withColumns({words: words_of(body), lines: F.filter(F.split(body, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")})
    words_in = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.size(words_of(x)))
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(plain)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)),
        "cleaned": F.array_join(F.filter(F.split(body, "\n", -1), lambda x: ~fails(x)), "\n"),
        "n_lost_words": words_in(F.filter(lines, fails)),
    }).drop(words, lines)
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= max_lost * F.col("n_words")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
