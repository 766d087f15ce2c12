"""Length buckets against exhaustive search, and batches that hold every row once."""

import random
from itertools import combinations

import pytest

from equiloom.llm import packing


def brute_padding(lengths, buckets):
    tops = sorted(set(lengths))
    best = None
    for count in range(1, min(buckets, len(tops)) + 1):
        for inner in combinations(tops[:-1], count - 1):
            edges = [*inner, tops[-1]]
            total = sum(min(e for e in edges if e >= n) - n for n in lengths)
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 20])
def test_least_padding(seed, buckets):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 9), rng.randint(1, 60)]) for _ in range(rng.randint(1, 40))]
    tops = sorted(set(lengths))
    if len(tops) > 14:
        lengths = [n for n in lengths if n <= tops[13]]
    bins = [(t, lengths.count(t), t * lengths.count(t)) for t in sorted(set(lengths))]
    chosen = packing.boundaries(bins, buckets)
    assert len(chosen) <= buckets
    assert sum(b.padding for b in chosen) == brute_padding(lengths, buckets)
    assert sum(b.rows for b in chosen) == len(lengths)


def test_no_rows():
    assert packing.boundaries([], 4) == []


def test_batches(spark):
    rng = random.Random(3)
    rows = [(n if n % 9 else None, "w " * rng.choice([0, 1, 5, 30, 31, 200]), n) for n in range(200)] + [(1, "w w", 0)] * 40 + [(777, None, 0), (778, "w " * 5000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    found = packing.pack(docs, buckets=3, budget=300).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in found) == sorted((i or -1, len((t or "").split()) + 1) for i, t, _ in rows)
    places = {(r["bucket"], r["batch"], r["slot"]) for r in found}
    assert len(places) == len(rows)
    batches = {}
    for r in found:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0
    for (bucket, batch), members in batches.items():
        room = max(1, 300 // members[0]["boundary"])
        assert sorted(m["slot"] for m in members) == list(range(len(members)))
        last = (bucket, batch + 1) not in batches
        assert len(members) == room or last and len(members) <= room
    assert sum(r["padding"] for r in found) == brute_padding([r["n_tokens"] for r in found], 3)
    assert packing.pack(docs.limit(0)).count() == 0


def test_order_does_not_follow_the_partitions(spark):
    docs = spark.createDataFrame([(n, "w " * (n % 13), "x") for n in range(300)], "doc_id long, text string, lang string")
    one = sorted(map(tuple, packing.pack(docs.repartition(1), buckets=4, budget=60).collect()))
    assert sorted(map(tuple, packing.pack(docs.repartition(7), buckets=4, budget=60).collect())) == one


def test_other_lengths(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, 5), (2, None)], "doc_id long, size int")
    assert sorted(r["n_tokens"] for r in packing.pack(docs, length=F.col("size")).collect()) == [1, 5]
