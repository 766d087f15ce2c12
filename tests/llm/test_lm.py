"""Partial matching against a direct definition, and the unigram beside it against plain counts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import ppm


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


class Brute:
    """Probability of a byte after a context by the definition: escape to the context one byte shorter, seen symbols excluded."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            data = b"\0" * order + text + b"\0"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[data[i - k:i]][data[i]] += 1

    def row(self, context):
        lower = [1 / 256] * 256 if not context else self.row(context[1:])
        seen = self.counts.get(context)
        if not seen:
            return lower
        total, kinds = sum(seen.values()), len(seen)
        rest = sum(p for b, p in enumerate(lower) if b not in seen)
        return [seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * p / rest for b, p in enumerate(lower)]

    def score(self, text):
        data = b"\0" * self.order + text + b"\0"
        return sum(math.log10(self.row(data[i - self.order:i])[data[i]]) for i in range(self.order, len(data)))


TEXTS = ["the cat sat on the mat", "The rat sat", "", None, "a é\u00a0b  c\n\td", "the the the the", "zq" * 30, "the cat sat on the mat"]


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_scores(spark, order):
    rows = [(n if n != 5 else None, t, n, n * 1.0) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int, score double")
    model = Brute([lowered(t).encode() for n, t in enumerate(TEXTS) if n % 4], order)
    for frequent in (ppm.FREQUENT, 0.2):  # with and without the join for rare words
        found = {r["doc_id"]: r for r in ppm.lm_scores(docs, F.coalesce(F.col("doc_id"), F.lit(5)) % 4 != 0, order=order, support=0.0, frequent=frequent).collect()}
        tokens = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""] for t in TEXTS]
        counts = Counter(w for n, words in enumerate(tokens) if n % 4 for w in words)
        total, kinds = sum(counts.values()), len(counts)
        assert len(found) == len(TEXTS)
        for n, text in enumerate(TEXTS):
            row = found[n if n != 5 else None]
            assert row["held_out"] == (n % 4 == 0)
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens[n]), sum(counts[w] > 0 for w in tokens[n]), total)
            assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens[n]))
            assert row["score"] == pytest.approx(model.score(lowered(text).encode()), rel=1e-5)


def test_rows_are_distributions():
    texts = [b"abracadabra", b"banana", b"\xff\x00x"]
    gram, count = ppm._grams(texts, 3)
    entries = []
    for k in range(4):
        context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
        pairs = Counter()
        for c, b, n in zip(context.tolist(), (gram & np.uint64(255)).tolist(), count.tolist(), strict=True):
            pairs[c, b] += n
        entries.append((np.array([c for c, _ in pairs], np.uint64), np.array([b for _, b in pairs]), np.array(list(pairs.values()))))
    trie = ppm.build(entries)
    assert np.allclose((10.0 ** trie.log10.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_support_bounds_the_trie(spark):
    docs = spark.createDataFrame([("".join(chr(97 + (i * j) % 26) for j in range(200)),) for i in range(30)], "text string")
    grams = ppm.counted(docs, 4).where("gram is not null").select("gram", "n")
    trie = ppm.trained_trie(grams, 4, 1 / 50)
    assert len(trie.log10) <= 1 + 4 * 50
    assert np.allclose((10.0 ** trie.log10.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_small_pieces_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(n, "the cat %d sat" % (n % 7)) for n in range(60)], "doc_id long, text string")
    whole = sorted(map(tuple, ppm.lm_scores(docs, F.col("doc_id") % 5 != 1).collect()))
    for name, value in (("CHUNK_BYTES", 40), ("HELD_WORDS", 3), ("HELD_GRAMS", 10)):
        monkeypatch.setattr(ppm, name, value)
    again = sorted(map(tuple, ppm.lm_scores(docs, F.col("doc_id") % 5 != 1).collect()))
    assert [r[:5] for r in again] == [r[:5] for r in whole]
    assert np.allclose([r[5:] for r in again], [r[5:] for r in whole])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in ppm.lm_scores(docs, F.lit(False)).collect()}
    assert found[1]["score"] == pytest.approx(3 * math.log10(1 / 256)) and found[1]["train_tokens"] == 0
    assert ppm.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_held_out_texts_beat_equal_bytes(spark):
    from equiloom.llm.queries import op6_lm_score

    directory = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: lowered(r["text"]) for r in spark.read.parquet(f"{directory}/documents.parquet").collect()}
    found = op6_lm_score(spark, directory).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    size = sum(len(texts[r["doc_id"]].encode()) + 1 for r in held)
    assert -sum(r["score"] for r in held) / size < 1.2  # log10 a byte; 2.41 if all were equally likely


@pytest.mark.parametrize("sent", [ppm.SENT_GRAMS, 0])
def test_every_context_counts_at_production_parameters(spark, monkeypatch, sent):
    monkeypatch.setattr(ppm, "SENT_GRAMS", sent)
    monkeypatch.setattr(ppm, "GROUP_BYTES", 20_000)
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.choice([*range(97, 117), 32], size))) for size in rng.integers(0, 900, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = Brute([t.encode() for n, t in enumerate(texts) if n % 4], ppm.ORDER)
    seen = Counter(c for c, n in model.counts.items() for _ in range(sum(n.values())) if len(c) == ppm.ORDER)
    assert min(seen.values()) < ppm.SUPPORT * sum(seen.values())  # or the trie would hold every context
    found = {r["doc_id"]: r["score"] for r in ppm.lm_scores(docs, F.col("doc_id") % 4 != 0).collect()}
    assert len(found) == len(texts)
    for n in range(0, len(texts), 3):
        assert found[n] == pytest.approx(model.score(texts[n].encode()), rel=1e-5)


def test_a_long_separator_in_every_text_is_no_join_key(spark, monkeypatch):
    line = "=" * 300
    docs = spark.createDataFrame([(n, f"{line} some word{n} {line}") for n in range(40)], "doc_id long, text string")
    joined = {}
    for longest in (ppm.FREQUENT_BYTES, 1 << 20):
        monkeypatch.setattr(ppm, "FREQUENT_BYTES", longest)
        found = ppm.lm_scores(docs, F.lit(True), order=1, frequent=0.1)
        joined[longest] = {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 9)) for r in found.collect()}
    assert len(joined[1 << 20]) == 40 and joined[ppm.FREQUENT_BYTES] == joined[64]
    # 40 of each frequent word, 80 lines, 40 ends, 40 words of their own.
    mass = 200 + 0.5 * (43 + 1)
    expected = 2 * math.log10(80.5 / mass) + 2 * math.log10(40.5 / mass) + math.log10(1.5 / mass)
    assert all(v == (5, 5, round(expected, 9)) for v in joined[64].values())


def test_kept_contexts_grow_with_the_corpus(spark):
    sizes = []
    for rows in (50, 500):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("doc_id") < rows)
        grams = ppm.counted(docs, ppm.ORDER).where("gram is not null").select("gram", "n")
        seen = grams.select(F.shiftright("gram", 8)).distinct().count()
        trie = ppm.trained_trie(grams, ppm.ORDER, ppm.SUPPORT)
        kept = ppm.missing_probabilities(grams, trie, ppm.ORDER).select(F.shiftright("gram", 8)).distinct().count() + len(trie.contexts)
        assert kept == seen
        sizes.append(kept)
    assert sizes[1] > 1.3 * sizes[0]
