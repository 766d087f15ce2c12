"""The pipeline's near-duplicate stage against all pairs' Jaccard similarity, and rows that share an id."""

import random
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import nearcopies


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([" ".join(words[i:i + 5]) for i in range(len(words) - 4)] or ([" ".join(words)] if words else []))


def brute_kept(rows):
    """(doc_id, text) rows that stay: of each component the least id, nulls last."""
    texts = sorted({t or "" for _, t in rows})
    sets = [brute_set(t) for t in texts]
    found = list(range(len(texts)))

    def top(i):
        while found[i] != i:
            i = found[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                found[top(i)] = top(j)
    of = {t: top(n) for n, t in enumerate(texts)}
    kept = {}
    for i, t in rows:
        kept.setdefault(of[t or ""], []).append((i is None, i or 0))
    return of, sorted((min(v), k) for k, v in kept.items())


def check(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
    assert set(left) <= set(rows)
    of, expected = brute_kept(rows)
    assert sorted(((i is None, i or 0), of[t or ""]) for i, t in left) == expected
    return left


def test_planted_copies_and_shared_ids(spark):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(3000)]
    rows = []
    for n in range(40):
        text = rng.choices(words, k=rng.choice([3, 30, 300]))
        rows.append((n % 10, " ".join(text)))  # ids are shared by unlike texts
        for _ in range(3):
            changed = list(text)
            for _ in range(rng.choice([0, 1, 5])):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((rng.choice([None, 5, 100 + n]), " ".join(changed).upper()))
    base = rng.choices(words, k=300)
    for n in range(100):  # a ball of copies, none equal
        copy = list(base)
        copy[rng.randrange(300)] = f"x{n}"
        rows.append((1000 + n, " ".join(copy)))
    rows += [(7, None), (8, ""), (None, " \n")]
    left = check(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"code": F.lit(1), "digest__": F.lit("x")}).repartition(3))
    assert sum(t is not None and t.startswith(" ".join(base[:2])) or i is not None and i >= 1000 for i, t in left) <= 1
    assert len([t for i, t in left if i == 3]) > 1
    assert check(spark, spark.createDataFrame([], "doc_id long, text string")) == []


def test_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_equal_ids_keep_a_row_of_each_text(spark):
    rows = [(2, "a b c d e f"), (5, "A b c d e f"), (2, "other words stand here"), (8, "other words stand here"), (2, "a third text of its own"), (2, "a third text of its own")]
    left = check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(left) == [(2, "a b c d e f"), (2, "a third text of its own"), (2, "other words stand here")]


def test_texts_without_words_are_copies_of_each_other(spark):
    rows = [(1, None), (2, None), (3, ""), (None, None), (9, " \t\n"), (4, "one word"), (4, "one word")]
    assert sorted(check(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, None), (4, "one word")]


def family(rng, count, core, own, changed=0):
    """Texts that begin alike, with ``core`` words, and go on with ``own`` words of theirs."""
    shared = [f"c{n}" for n in range(core)]
    out = []
    for n in range(count):
        words = shared + [f"o{n}x{i}" for i in range(own)]
        for _ in range(changed):
            words[rng.randrange(len(words))] = f"z{rng.random()}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_small_blocks_and_slices_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "PARTNERS", 2)
    rng = random.Random(block)
    texts = family(rng, 40, 100, 40) + family(rng, 60, 200, 4, 3) + family(rng, 30, 60, 9, 1)
    chain = [f"k{n}" for n in range(120)]
    for n in range(25):  # each is near to the next only
        chain[n * 4:n * 4 + 4] = [f"k{n}.{i}" for i in range(4)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = [(r["doc_id"], r["text"]) for r in nearcopies.one_of_each(docs, block).collect()]
    of, expected = brute_kept(rows)
    assert sorted(((False, i), of[t]) for i, t in left) == expected


def test_units_hold_blocks_and_no_tree_meets_itself(spark):
    rng = random.Random(2)
    rows = [(1, f"c{n}", "hot") for n in range(500)] + [(1, f"d{n}", "warm") for n in range(70)] + [(1, f"e{n}", f"t{rng.randrange(30)}") for n in range(90)] + [(2, f"f{n}", "one") for n in range(50)]
    placed = spark.createDataFrame([(b, c.encode(), t.encode()) for b, c, t in rows], "band long, code binary, tree binary")
    filed, meet = nearcopies.units(placed, 20)
    blocks = {}
    for r in filed.collect():
        blocks.setdefault((r["band"], bytes(r["big"]), r["slot"]), set()).add((bytes(r["code"]), bytes(r["tree"])))
    assert {b for b, _, _ in blocks} == {1} and max(map(len, blocks.values())) <= 60
    met = set()
    pairs = [((r["band"], bytes(r["big"]), r["slot"]), (r["band"], bytes(r["big2"]), r["slot2"])) for r in meet.collect()]
    assert not any(a[1] == b[1] != b"" for a, b in pairs)
    for a, b in pairs:
        inside = blocks.get(a, set()) | blocks.get(b, set())
        met |= {frozenset((x, y)) for x, tx in inside for y, ty in inside if tx != ty}
    codes = [(c.encode(), t.encode()) for b, c, t in rows if b == 1]
    assert met == {frozenset((x, y)) for x, tx in codes for y, ty in codes if tx != ty}


def test_a_large_family_without_links_is_done_in_seconds(spark):
    texts = family(random.Random(1), 20_000, 150, 146)  # similarity 0.33
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.time()
    assert nearcopies.one_of_each(docs).count() == len(texts)
    assert time.time() - start < 120


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)])
def test_recall_by_similarity(spark, low, high):
    """Planted pairs of every similarity from the least on, alone in a table of other texts."""
    rng = random.Random(int(low * 100))
    words = [f"w{n}" for n in range(5000)]
    rows, planted = [], 0
    while planted < 200:
        text = rng.choices(words, k=rng.choice([40, 150, 400]))
        copy = list(text)
        for _ in range(rng.randrange(1, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        a, b = brute_set(" ".join(text)), brute_set(" ".join(copy))
        if low <= len(a & b) / len(a | b) < high:
            rows += [(2 * planted, " ".join(text)), (2 * planted + 1, " ".join(copy))]
            planted += 1
    left = {r["doc_id"] for r in nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert left >= {2 * n for n in range(planted)} and len(left) - planted <= 0.01 * planted


def test_the_simhash_index_files_texts_that_share_no_band(spark):
    rows = [(b"a", 0, [1]), (b"b", 0b111, [2]), (b"c", 0b111111, [3]), (b"d", -1, [4]), (b"e", 0, [])]  # three bits apart in a chain, far off, without words
    codes = spark.createDataFrame([(bytearray(c), f, b) for c, f, b in rows], "code binary, fingerprint long, bands array<long>")
    found = nearcopies.buckets(codes).collect()
    assert sorted(bytes(r["code"]) for r in found) == [b"a", b"b", b"c"] and len({r["band"] for r in found}) == 1
    assert {(bytes(r["first"]), r["n"]) for r in found} == {(b"a", 3)}


def test_pairs_within_three_bits_are_found_without_minhash(spark):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(5000)]
    texts = []
    for _ in range(100):
        text = rng.choices(words, k=2000)
        texts += [" ".join(text), " ".join([*text[:-1], "changed"])]
    prints = nearcopies.printed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    of = {r["doc_id"]: r for r in prints.collect()}
    near = {n for n in range(0, 200, 2) if ((of[n]["fingerprint"] ^ of[n + 1]["fingerprint"]) & (1 << 64) - 1).bit_count() <= 3}
    alone = prints.withColumn("bands", F.array(F.monotonically_increasing_id()))
    band = {bytes(r["code"]): r["band"] for r in nearcopies.buckets(alone.select("code", "fingerprint", "bands")).collect()}
    assert len(near) > 90 and all(band[bytes(of[n]["code"])] == band[bytes(of[n + 1]["code"])] for n in near)


def test_joined_trees_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 1 << 63, 60, np.uint64))]
        while len(sets) < 40:
            one = sets[rng.integers(len(sets))].copy()
            one[rng.integers(0, len(one), rng.integers(1, 9))] = rng.integers(0, 1 << 63, 1, np.uint64)
            sets.append(np.unique(one))
        signs = np.array([nearcopies.minima(s).astype(np.uint8) for s in sets])
        tree = np.unique(rng.integers(0, 25, len(sets)), return_inverse=True)[1]
        top = list(range(tree.max() + 1))

        def root(i, top=top):
            while top[i] != i:
                i = top[i]
            return i

        pairs = nearcopies.joined(sets, signs, tree)
        for a, b in pairs:
            top[root(b)] = root(a)
        near = [(i, j) for i in range(40) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        brute = list(range(tree.max() + 1))
        for i, j in near:
            brute[root(tree[i], brute)] = root(tree[j], brute)
        mine = [root(t) for t in range(len(top))]
        assert len({(root(t, brute), mine[t]) for t in range(len(top))}) == len({root(t, brute) for t in range(len(top))}) == len(set(mine))
