"""Line rules, counts and verdicts against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from equiloom.llm import quality

SPACE = " \t\n\x0b\f\r"


def brute_rule(line):
    words = re.findall(quality.WORD, line)
    bars, marks = (sum(line.count(s) for s in signs) for signs in (quality.SEPARATORS, quality.MARKS))
    if not words:
        return None
    if len(words) <= 30 and any(n in line.lower() for n in quality.NOTICES):
        return "boilerplate"
    if bars >= 3 and len(words) <= 4 * (bars + 1) + bars:
        return "navigation"
    if len(words) <= 30 and all(w in quality.MENU for w in re.split(r"[,;/\x20\x09-\x0D]+", line.lower().strip(SPACE + ",;/"))):
        return "navigation"
    if len(words) >= 4 and marks > len(words):
        return "marks"
    return None if line.rstrip(SPACE + quality.CLOSING)[-1:] in quality.ENDS else "punctuation"


def brute_repeats(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)})


def brute(text):
    text = text or ""
    words, lines = re.findall(quality.WORD, text), text.split("\n")
    repeats = brute_repeats(words)
    worded = [x for x in lines if x.strip(SPACE)]
    removed = [(n + 1, brute_rule(x)) for n, x in enumerate(lines) if brute_rule(x)]
    cleaned = "\n".join(x for x in lines if not brute_rule(x))
    chars, left = (len(re.sub(r"[\x20\x09-\x0D]", "", t)) for t in (text, cleaned))
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    return (len(words), chars, sum(text.count(s) for s in quality.SYMBOLS), len(worded) - len(set(worded)), repeats, failed, removed, cleaned, not failed and 2 * left >= chars)


TEXTS = [
    None, "", " \n\t\r\n ", "One.", "a b c d e f g h i " * 3, "a " * 9, "   non breaking spaces are words.",
    "Home | About us | Contact | Help\n" + "This line is plain prose with a good end. " * 4, "Home About Login\nThis is a sentence of its own, with \"quotes.\"\n" * 3,
    "home,about;login\nHOME / top /", "All rights reserved.\nThis site USES COOKIES for everything.\n" + "word " * 31 + "click here to be kept because the line is long.",
    "WORD!! WORD!! WORD!! WORD!!\nwell... yes... no...\n\nA & B.\r\n(He left.)\r\n« Oui. »\nno end\n" + "Longer prose that keeps the share of text above half of it all, as it should be. " * 2,
    "x" * 100_000, "ünïcödé 漢字。\n漢字 𝔘𝔫𝔦 end？\n" * 12, "\n".join(f"Line {n} of many different lines." for n in range(3000)),
]


def check(spark, texts):
    docs = spark.createDataFrame([(n, t, "v", 1) for n, t in enumerate(texts)], "doc_id long, text string, verdicts__ string, cleaned int").repartition(4)
    out = quality.judged(docs)
    assert out.columns == [*docs.columns, "judgement"]
    for row in out.collect():
        j = row["judgement"].asDict()
        found = (j["n_words"], j["word_chars"], j["n_symbols"], j["n_dup_lines"], j["n_repeat_words"], j["base_failed"], [tuple(x) for x in j["removed"]], j["cleaned"], j["kept"])
        assert found == brute(texts[row["doc_id"]]), texts[row["doc_id"]][:80]
        assert (row["verdicts__"], row["cleaned"]) == ("v", 1)
    return out


def test_texts(spark):
    check(spark, TEXTS)


def test_random_texts(spark):
    rng = random.Random(6)
    parts = ["the", "a", "run.", "end!", "|", "home", "»", "$$$", "all rights reserved", "\n", "\n", "(so.)", "\r", "é", "same words come back again and again here today."]
    check(spark, ["".join(rng.choice(parts) + rng.choice(" \n ") for _ in range(rng.randrange(120))) for _ in range(300)])


def test_repeated_windows_at_the_edges():
    for words in (list("abcdefgh"), list("aaaaaaaa"), list("aaaaaaaaa"), list("abcdefghabcdefgh"), list("abcdefghiabcdefgh"), list("xabcdefghyabcdefghz")):
        assert quality.repeated_words([w.encode() for w in words]) == brute_repeats(words)


def test_cleaned_keeps_columns_and_empty_tables(spark):
    prose = " ".join(f"word{n}" for n in range(40)) + "."
    docs = spark.createDataFrame([(None, f"Home | A | B | C\n{prose}", 5), (1, None, 6)], "doc_id long, text string, judgement int")
    assert list(map(tuple, quality.cleaned(docs).collect())) == [(None, prose, 5)]
    assert quality.judged(docs).columns == docs.columns
    assert quality.judged(docs.where(F.lit(False))).collect() == quality.cleaned(docs.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.01"])
def test_labels_of_quality(spark, directory):
    """The verdict learns nothing, yet agrees with nearly all labels of texts that the base rules pass."""
    docs, labels = (spark.read.parquet(f"{directory}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.judged(docs).join(labels, "doc_id").where("quality is not null and not judgement.base_failed").select("quality", "judgement.kept").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2
