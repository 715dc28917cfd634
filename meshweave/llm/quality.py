"""Quality rules, line first: lines that fail punctuation, navigation or boilerplate rules go; documents that lose too
much text that way, or fail the base rules, are rejected. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Names, barrier

#: Ends of a sentence, and the closing quotes and brackets that may follow, as many as there are.
TERMINAL, CLOSING = ".!?:;…。！？", "\"'”’»)]"
BLANKS = " \t\n\x0b\f\r"
#: Words that only separate the links of a navigation bar.
SEPARATOR = r"(?<!\S)(?:[|»›>•·/–—-]|::)(?!\S)"
#: Phrases of notices and page furniture.
BOILERPLATE = (
    "all rights reserved|copyright|licensed under|released under|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|"
    "accept cookies|enable javascript|subscribe to our|sign up for|log in|read more|click here|share this|powered by|lorem ipsum"
)
SYMBOLS = r"[#*$%&|<>]"
#: Lines of fewer words need no end of sentence (headings), and a notice has at most so many.
HEADING_WORDS, NOTICE_WORDS = 4, 25
#: Shares of a line's characters that may be symbols, and of its words that may be separators.
MOST_SYMBOLS, MOST_SEPARATORS = 0.1, 0.2
#: Repeated windows up to which they are looked up one by one (a matter of speed alone).
FEW = 24
#: Share of its characters in words that a document may lose.
MOST_LOST = 0.5


def _line_passes(line: Column, words: Column) -> Column:
    """Whether a line of so many words passes the punctuation, navigation and boilerplate rules."""
    ended = F.contains(F.lit(TERMINAL), F.right(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSING)), F.lit(1))) | (words < HEADING_WORDS)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) <= MOST_SYMBOLS * F.length(line)
    separators = F.regexp_count(line, F.lit(SEPARATOR)) <= MOST_SEPARATORS * words
    notice = (words <= NOTICE_WORDS) & line.rlike(f"(?i){BOILERPLATE}")
    return ended & symbols & separators & ~notice


def _repeated_words(df: DataFrame, n: Names) -> DataFrame:
    """Add n.repeated: words in 3-word windows that the text holds twice or more. Needs n.words.

    Sorted hashes of the windows show which occur twice. Where there are few such, windows are looked up among them;
    else hashes sorted with their places have an equal neighbour. The places, in order, cover three words at most each.
    All of it stays within the row, so nothing is shuffled.
    """
    df = barrier(df, **{n.hashes: F.transform(n.words, lambda w: F.xxhash64(w))})
    last = F.size(n.words) - 3
    # from 0 up even for short texts, as sequence would count down
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get(n.hashes, i), F.get(n.hashes, i + 1), F.get(n.hashes, i + 2)))
    df = barrier(df, **{n.windows: F.when(last >= 0, windows)})
    df = barrier(df, **{n.sorted: F.sort_array(n.windows)})
    df = barrier(df, **{n.twice: F.array_distinct(F.filter(n.sorted, lambda x, k: x == F.get(n.sorted, k - 1)))})
    looked_up = F.array_compact(F.transform(n.windows, lambda x, i: F.when(F.array_contains(n.twice, x), i)))
    df = barrier(df, **{n.placed: F.when(F.size(n.twice) > FEW, F.sort_array(F.transform(n.windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))})
    beside = F.filter(n.placed, lambda x, k: (x["h"] == F.get(n.placed, k - 1)["h"]) | (x["h"] == F.get(n.placed, k + 1)["h"]))
    places = F.when(F.size(n.twice) == 0, F.array().cast("array<int>")).when(F.size(n.twice) <= FEW, looked_up).otherwise(F.sort_array(F.transform(beside, lambda x: x["i"])))
    df = barrier(df, **{n.places: places})
    covered = F.transform(n.places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(n.places, k + 1) - x, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return df.withColumn(n.repeated, F.coalesce(total, F.lit(0).cast("bigint")))


def quality(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Judge every document: the input's columns and a struct named `into`.

    It holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and clean_text (the lines
    that pass, in order, with the blank ones). Null texts count as having no words: base_failed, clean_text empty.
    Repeated rows are judged each; an empty table gives an empty table; the input may have columns of any names (one
    named as `into` is replaced). Lines of any length are judged whole.
    """
    n = Names(docs)
    df = docs.drop(into).select("*", F.coalesce(F.col(text), F.lit("")).alias(n.body))
    df = barrier(df, **{n.words: F.filter(F.split(n.body, SPACES), lambda w: w != ""), n.lines: F.split(n.body, "\n")})
    df = _repeated_words(df, n)
    blank = r"[^\x20\x09-\x0D]"
    worded = F.filter(n.lines, lambda x: x.rlike(blank))
    counted = F.transform(n.lines, lambda x: F.struct(x.alias("line"), F.size(F.split(x, SPACES)).alias("words")))
    df = barrier(df, **{n.worded: worded, n.counted: counted})
    passing = F.filter(n.counted, lambda x: ~x["line"].rlike(blank) | _line_passes(x["line"], x["words"]))
    df = barrier(df, **{n.clean: F.array_join(F.transform(passing, lambda x: x["line"]), "\n")})
    df = df.withColumn(n.n, F.size(n.words).cast("bigint")).withColumn(n.chars, F.length(F.array_join(n.words, "")).cast("bigint"))
    failed = (F.col(n.n) < 50) | (100 * F.col(n.repeated) > 50 * F.col(n.n))
    left = F.length(n.clean) - F.regexp_count(n.clean, F.lit(r"[\x20\x09-\x0D]"))
    judged = F.struct(
        F.col(n.n).alias("n_words"),
        F.col(n.chars).alias("word_chars"),
        F.regexp_count(n.body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size(n.worded) - F.size(F.array_distinct(n.worded))).cast("bigint").alias("n_dup_lines"),
        F.col(n.repeated).alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (left >= (1 - MOST_LOST) * F.col(n.chars))).alias("kept"),
        F.col(n.clean).alias("clean_text"),
    )
    return n.drop_from(df.select("*", judged.alias(into)))
