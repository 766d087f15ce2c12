"""SimHash: fingerprints and classes against brute force, and defined results for odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from equiloom.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(codes):
    """Smallest index reachable over links of two bits or fewer."""
    found = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= 2 and found[j] < found[i]:
                    found[i], changed = found[j], True
    return found


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "É é a b c d a b c d", "x\u00a0y z\x1cw q", "a b c " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) & (1 << 64) - 1 == brute_fingerprint(text)


def test_fingerprint_in_pieces(monkeypatch):
    text = " ".join(map(str, range(1000))).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


def test_fingerprint_is_sparks_hash(spark):
    assert spark.sql("SELECT xxhash64('a b ü')").first()[0] == np.int64(np.uint64(xxhash.xxh64_intdigest("a b ü".encode(), 42)))


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(codes ^ (codes >> np.uint64(1))), codes)


@pytest.mark.parametrize("spread", [3, 9, 40])
def test_every_link_is_found(spread):
    rng = random.Random(spread)
    codes = sorted({rng.getrandbits(64) if rng.random() < 0.3 else sum(1 << rng.randrange(spread) for _ in range(2)) for _ in range(600)})
    codes = np.array(codes, np.uint64)
    group = np.arange(len(codes)) % 2
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    found = {(int(a), int(b)) for x, y in simhash.linked_within(codes, group, 2) for a, b in zip(x, y, strict=True)}
    expected = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 2}
    assert found == expected


@pytest.mark.parametrize("node_limit", [1 << 15, 20])
def test_classes(spark, node_limit):
    rng = random.Random(5)
    codes = {rng.getrandbits(64) for _ in range(40)} | {0}
    for _ in range(400):  # chains, and a dense ball that overfills its upper nodes
        codes.add(rng.choice(sorted(codes)) ^ sum(1 << b for b in rng.sample(range(64) if rng.random() < 0.3 else range(7), 2)))
    codes = sorted(codes)
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), 2, node_limit)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    found = [roots.get(c, c) for c in signed]
    expected = brute_classes(codes)
    assert len(set(expected)) == len(set(found))
    assert len(set(zip(expected, found, strict=True))) == len(set(expected))


def test_rounds_hold_no_broadcast_and_end_with_stars(spark, monkeypatch):
    plans, stored = [], simhash.stored

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(simhash, "stored", noted)
    chain = spark.createDataFrame([(n, n + 1) for n in range(40)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(chain).collect()} == {(n, 0) for n in range(41)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
    assert all("SortMergeJoin" in p for p in plans[1:])
    plans.clear()
    stars = spark.createDataFrame([(7, 1), (1, 9), (4, 3), (3, 4), (5, 5)], "a long, b long")
    assert sorted((r["node"], r["root"]) for r in simhash.components(stars).collect()) == [(1, 1), (3, 3), (4, 3), (7, 1), (9, 1)]
    assert len(plans) == 1


def test_odd_rows(spark):
    rows = [(5, "a b c d", 1), (2, "A  b\tc d", 2), (2, "other words stand here", 3), (None, "a b c d", 4), (9, None, 5), (7, "", 6), (8, "other words stand here", 7), (8, "other words stand here", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, 2), (2, 2), (2, 2), (None, 2), (9, 7), (7, 7), (8, 2), (8, 2)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from equiloom.llm.queries import op1_simhash

    directory = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect())
    codes = [brute_fingerprint(t) for _, t in docs]
    expected = {i: (f"{c:016x}", docs[k][0]) for (i, _), c, k in zip(docs, codes, brute_classes(codes), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op1_simhash(spark, directory).collect()} == expected
