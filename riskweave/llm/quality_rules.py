"""Line-first cleaning of documents, in DataFrame expressions only.

Every line is judged by itself (navigation, shouting, symbols, repetition,
boilerplate, missing punctuation), failing lines are removed, and a document goes
when too little of it is left.  Before that, two counts over the whole document
decide: too few words, or too many words in phrases that come again.

All of it is a projection: no shuffle, no Python, a text is read once.  Repeated
phrases are found by sorting (hash, position) pairs inside the row, n log n in the
document's words, and equal hashes are confirmed on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.llm.common import fresh, let

#: Characters that part words, besides the line feed that parts lines.
SPACES = " \t\r\x0b\f"
SYMBOLS = "#*$%&|<>"

#: Phrases of lines that belong to a page, not to its text.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "log in", "powered by",
    "privacy policy", "read more", "released under", "share this", "sign in", "sign up", "skip to content",
    "subscribe to", "terms of service", "terms of use", "use of cookies",
)
#: Characters that end a sentence, before closing quotes and brackets.
SENTENCE_END = r"[.!?:;。！？…؟।][\"'”’»)\]}]*\s*$"


def without(text: Column, chars: str) -> Column:
    """``text`` less some characters; a character that it lacks costs one fast scan."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(without(text, chars))).cast("long")


def words_of(line: Column) -> Column:
    """Words of a line.  Splitting at one plain character needs no pattern matching."""
    for c in SPACES[1:]:
        line = F.replace(line, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(line, " "), "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Number of words that lie in some window of ``size`` words which occurs twice or more."""
    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda a, b: F.slice(words, a + 1, size) == F.slice(words, b + 1, size)
            hit = F.transform(F.slice(s, 2, F.size(s)), lambda x, k: F.when(
                (x["h"] == s[k]["h"]) & same(x["i"], s[k]["i"]), F.array(x["i"], s[k]["i"])))
            starts = F.array_distinct(F.flatten(F.filter(hit, lambda x: x.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(*[p + j for j in range(size)])))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, positions))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))),
                          lambda w, i: F.xxhash64(w, *[words[i + j] for j in range(1, size)]))
    return let(windows, found).cast("long")


#: Found in every text in which a line can be navigation, symbols or shouting.
ODD = r"[|›»•·>#*$%&<]|\p{Lu}{3}"


def line_fails(line: Column, w: Column, odd: Column) -> Column:
    """Is a line (with its words) navigation, shouting, symbols, repetition, boilerplate or a fragment?

    ``odd`` says whether the text matches ``ODD`` at all; it spares ordinary texts
    three scans of each line.  A line without a word does not fail; it has nothing to lose.
    """
    n = F.size(w)
    capitals, letters = F.regexp_count(line, F.lit(r"\p{Lu}")), F.regexp_count(line, F.lit(r"\p{L}"))
    bars = n - F.size(F.filter(w, lambda x: ~x.isin("|", "›", "»", "•", "·", ">")))
    return (n > 0) & (
        ((n < 4) & ~line.rlike(SENTENCE_END))
        | ((n <= 12) & F.lower(line).rlike("|".join(BOILERPLATE)))
        | (odd & (((n >= 5) & (count_of(line, SYMBOLS) * 4 >= n))
                  | ((bars >= 3) & (bars * 4 >= n))
                  | ((n >= 5) & (capitals * 10 >= letters * 7) & line.rlike(r"\p{Lu}{3}"))))
        | ((n >= 8) & (F.size(F.array_distinct(w)) * 3 <= n)))


def examine(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words over the whole text, and cleaned.

    cleaned is the text less its failing lines, with a line feed between those that
    stay.  Lines are split into words once, for the counts and for the rules.
    """
    text = F.coalesce(text, F.lit(""))

    def counts(lines: Column) -> Column:
        split = F.transform(lines, lambda x: F.struct(x.alias("line"), words_of(x).alias("w")))
        return let(split, lambda x: let(text.rlike(ODD), lambda odd: judged(x, odd)))

    def judged(lines: Column, odd: Column) -> Column:
        worded = F.transform(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda x: x["line"])
        good = F.filter(lines, lambda x: ~line_fails(x["line"], x["w"], odd))
        return let(F.flatten(F.transform(lines, lambda x: x["w"])), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(without(text, SPACES + "\n")).cast("long").alias("word_chars"),
            F.when(odd, count_of(text, SYMBOLS)).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("cleaned")))
    return let(F.split(text, "\n"), counts)


def verdict(b: Column, *, min_words: int = 50, max_repeat_pct: int = 50, max_lost_pct: int = 50) -> tuple[Column, Column, Column]:
    """(base_failed, lost_pct, kept) of an examined text.  A text without words has lost nothing; it fails the base rule."""
    failed = (b["n_words"] < min_words) | (100 * b["n_repeat_words"] > max_repeat_pct * b["n_words"])
    lost = b["word_chars"] - F.length(without(b["cleaned"], SPACES + "\n"))
    lost_pct = F.when(b["word_chars"] > 0, 100.0 * lost / b["word_chars"]).otherwise(F.lit(0.0))
    return failed, lost_pct, ~failed & (lost_pct <= max_lost_pct)


def judge(docs: DataFrame, **limits) -> DataFrame:
    """Per row of documents: doc_id, the base counts, base_failed, cleaned, lost_pct, kept.

    NULL and empty texts have no words and fail the base rule.  Rows that repeat a
    doc_id are judged each.  Columns other than doc_id and text are not read.
    """
    counted = docs.select("doc_id", examine(F.col("text").cast("string")).alias("b"))
    failed, lost_pct, kept = verdict(F.col("b"), **limits)
    counts = [f"b.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return counted.select("doc_id", *counts, failed.alias("base_failed"), "b.cleaned", lost_pct.alias("lost_pct"), kept.alias("kept"))


def cleaned(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of documents, all columns: text without its failing lines, n_chars to match if there is one."""
    name = fresh(docs, "examined")
    marked = docs.withColumn(name, examine(F.col("text").cast("string")))
    new = {"text": F.col(f"{name}.cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(f"{name}.cleaned").cast(docs.schema["n_chars"].dataType)
    return marked.where(verdict(F.col(name), **limits)[2]).withColumns(new).select(*docs.columns)
