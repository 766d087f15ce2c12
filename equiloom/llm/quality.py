"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much of its text is rejected.

A line with a word fails by the first of these rules that it breaks:
``boilerplate`` a fixed phrase of notices in a line of at most ``SHORT`` words;
``navigation``  three or more separators, with at most ``ITEM_WORDS`` words to an item on average, or nothing but menu words;
``marks``       from ``FEW`` words on, more marks than words (decorated or shouted words);
``punctuation`` no sentence end at the end of the line, closing quotes and brackets aside.
Lines are judged in DataFrame functions. Repeated windows of words need a count over a whole text's windows: an Arrow function
ranks windows of one, two, four and eight words in numpy, exact and with memory in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

#: Space and the five ASCII control characters from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|<>»«›‹•·→"
MARKS = "#*$%&|<>!?.~^=_"
ENDS = (".", "!", "?", "…", "。", "！", "？", "؟", "।", ":", ";")
CLOSING = "\"'”’»)]}”"
SHORT, ITEM_WORDS, FEW = 30, 4, 4
#: Fixed phrases of notices, and words of menus.
NOTICES = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "uses cookies", "use of cookies",
    "accept cookies", "enable javascript", "requires javascript", "lorem ipsum", "subscribe to our newsletter", "click here", "read more", "sign up for",
    "licensed under", "released under the", "powered by", "skip to content", "share this", "follow us on", "copyright \N{COPYRIGHT SIGN}", "\N{COPYRIGHT SIGN} copyright",
)
MENU = ("home", "about", "contact", "login", "logout", "menu", "search", "next", "previous", "back", "help", "faq", "sitemap", "register", "subscribe", "share", "print", "top")
RULES = ("boilerplate", "navigation", "marks", "punctuation")
WINDOW = 8


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def measured(line: Column) -> Column:
    """What the rules ask of a line, each counted once."""
    end = F.substring(F.rtrim(line, F.lit(SPACE + CLOSING)), -1, 1)
    return F.struct(line.alias("line"), _words(line).alias("words"), _count(line, SEPARATORS).alias("separators"), _count(line, MARKS).alias("marks"), end.alias("end"))


def broken_rule(line: Column) -> Column:
    """Name of the first rule a measured line breaks; null for a line that stays, blank ones included."""
    words, separators = line["words"], line["separators"]
    notice = (words <= SHORT) & line["line"].rlike("(?i)(?:" + "|".join(NOTICES) + ")")
    menu = (words <= SHORT) & line["line"].rlike(r"(?i)^(?:[\x20\x09-\x0D]*(?:" + "|".join(MENU) + r")[,;/\x20\x09-\x0D]*)+$")
    bar = (separators >= 3) & (words <= ITEM_WORDS * (separators + 1) + separators)
    return (
        F.when(words == 0, F.lit(None)).when(notice, "boilerplate").when(bar | menu, "navigation")
        .when((words >= FEW) & (line["marks"] > words), "marks").when(~line["end"].isin(*ENDS), "punctuation")
    )


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that stand in the text twice or more, the first ones included."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
        rank, size = np.unique(pairs, return_inverse=True)[1], 2 * size
    often = np.bincount(rank)[rank] > 1
    # A word is covered if a repeated window starts at it or up to window - 1 words before.
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:len(often)] += often
    edges[window:window + len(often)] -= often
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


@F.pandas_udf(LongType())
def _repeats(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([repeated_words(t.split()) for t in batch], dtype="int64")


def judged(docs: DataFrame, text: str = "text", least: float = 0.5, name: str = "judgement") -> DataFrame:
    """``docs`` with a struct column ``name``, which takes the place of a column of that name; rows and other columns stay.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier line), n_repeat_words;
    base_failed: fewer than 20 words, or over 30 % of them repeated; removed: (number from 1, rule) of each failing line;
    cleaned: the other lines, in order; kept: not base_failed, and cleaned has at least the share ``least`` of the text's characters in words.
    A null text is taken as empty and fails by its words; texts of any length are judged whole; repeated rows and tied lines are judged each.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(whole, "\n")
    verdicts = F.transform(F.transform(lines, measured), lambda x, at: F.struct((at + 1).alias("number"), x["line"].alias("line"), broken_rule(x).alias("rule")))
    worded = F.filter(lines, lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    n_repeat = _repeats(whole.cast("binary"))
    names = []
    for part in ("verdicts", "repeats", "words", "chars", "worded"):
        while f"{part}__" in docs.columns or part in docs.columns:
            part += "_"
        names.append(f"{part}__")
    v, r, w, c, d = names
    rows = docs.withColumns({v: verdicts, r: n_repeat, w: _words(whole).cast("long"), c: F.length(F.translate(whole, SPACE, "")).cast("long"), d: worded})
    cleaned = F.array_join(F.transform(F.filter(v, lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n")
    failed = (F.col(w) < 20) | (100 * F.col(r) > 30 * F.col(w))
    left = F.length(F.translate(cleaned, SPACE, ""))
    judgement = F.struct(
        F.col(w).alias("n_words"), F.col(c).alias("word_chars"), _count(whole, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(d) - F.size(F.array_distinct(d))).cast("long").alias("n_dup_lines"), F.col(r).alias("n_repeat_words"), failed.alias("base_failed"),
        F.transform(F.filter(v, lambda x: x["rule"].isNotNull()), lambda x: F.struct(x["number"].alias("number"), x["rule"].alias("rule"))).alias("removed"),
        cleaned.alias("cleaned"), (~failed & (left >= F.lit(least) * F.col(c))).alias("kept"),
    )
    return rows.withColumn(name, judgement).drop(*names)


def cleaned(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents kept, their failing lines removed; columns stay as they are."""
    name = "judgement__"
    while name in docs.columns:
        name += "_"
    rows = judged(docs, text, least, name).where(F.col(name)["kept"])
    return rows.withColumn(text, F.col(name)["cleaned"]).drop(name)
