"""The prefix trie against plain Python, its parentheses, shards and long conversations."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiloom.llm import prefixtrie
from equiloom.llm.parentheses import Parentheses, range_min

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_of(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def brute_rebuilt(convs, block=100):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - (abs(c) % block) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        below = children.get(n, [])
        leaves[n] = sum(leaves[b] for b in below) or 1
        saved[n] = sum(saved[b] for b in below) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
    ends = {n: ",".join(map(str, sorted(c for c in nodes[n] if len(convs[c]) == len(n)))) for n in nodes}
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items()), key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def trie(spark, rows, extra=False):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string").repartition(7)
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(prefixtrie.ordered_turns(table)))


def random_rows(rng, count):
    rows = []
    for c in rng.sample(range(-150, 1200), count):
        for turn in range(rng.randrange(1, 12)):
            text = rng.choice(["a", "bb", "ccc", "", None]) if turn else rng.choice(["hot", "hot", "x"])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]) if turn > 3 else "user", text))
    return rows


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 300)
    rows += rows[:40] + [(None, 0, "user", "lost"), (700, None, None, None)] + [(1100 + i, t, "user", f"same {t}") for i in range(90) for t in range(7)]
    assert found(trie(spark, rows)) == brute(brute_rebuilt(turns_of(rows)))
    assert found(trie(spark, [])) == found(trie(spark, [(None, 1, "a", "b")])) == []


def test_turnless_conversations(spark):
    # Short conversations whose base is absent lose all their turns.
    rows = [(c, 0, "user", "a") for c in range(101, 160)]
    convs = brute_rebuilt(turns_of(rows))
    assert any(not seq for seq in convs.values())
    assert found(trie(spark, rows)) == brute(convs)


@pytest.mark.parametrize("depth", [1, 2, 3, 32])
@pytest.mark.parametrize("shards", [1, 13])
def test_long_conversations_over_pieces_and_shards(spark, depth, shards):
    rng = random.Random(depth * 100 + shards)
    convs = {}
    for c in range(60):
        seq = list(rng.choice(list(convs.values()))) if convs and rng.random() < 0.8 else []
        seq = seq[:rng.randrange(len(seq) + 1)] + [("r", rng.choice(["a", "bb"])) for _ in range(rng.choice([0, 1, 5, 70 if c % 9 == 0 else 3]))]
        convs[c * 7 % 61] = seq
    rows = [(c, d + 1, hashlib.sha256(repr(t).encode()).digest(), len(t[1])) for c, seq in convs.items() for d, t in enumerate(seq)]
    turns = spark.createDataFrame(rows, "conv_id long, depth long, digest binary, chars long").repartition(5)
    every = spark.createDataFrame([(c, len(s)) for c, s in convs.items()], "conv_id long, depth long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(prefixtrie.prefix_trie(turns, every, depth)) == brute(convs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SEGMENT_BITS", 3)
    rows = [(5, None, "user", "same")] * 300 + [(6, t, "user", "same") for t in range(200)] + [(c, 0, "user", "other") for c in range(10, 40)]
    assert found(trie(spark, rows)) == brute(brute_rebuilt(turns_of(rows)))


def test_ends_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS_AT_ONCE", 4)
    rows = [(c, t, "user", "common") for c in range(200, 290) for t in range(6)]
    assert found(trie(spark, rows)) == brute(brute_rebuilt(turns_of(rows)))


def test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    out = prefixtrie.prefix_trie(*prefixtrie.rebuilt(prefixtrie.ordered_turns(table.withColumn("copy", F.lit(1)))))
    assert found(out) == brute(brute_rebuilt(turns_of(rows)))


def test_parentheses():
    rng = random.Random(1)
    for count in (1, 2, 40, 63, 64, 65, 700, 5000):
        for share in (0.3, 0.5, 0.95):
            bits, stack, closes, left, start = [], [], {}, count, None
            while left or stack:
                if left and (not stack or rng.random() < share):
                    stack.append(len(bits))
                    bits.append(1)
                    left -= 1
                else:
                    start = stack.pop()
                    closes[start] = len(bits)
                    bits.append(0)
            tree = Parentheses(np.array(bits))
            found_closes = tree.findclose(tree.opens)
            assert found_closes.tolist() == [closes[i] for i in tree.opens]
            pairs = [sum(bits[j] and not bits[j + 1] for j in range(i, c)) for i, c in zip(tree.opens[:200], found_closes[:200], strict=True)]
            assert tree.leaves(tree.opens, found_closes)[:200].tolist() == pairs
    values = np.array([rng.randrange(50) for _ in range(77)])
    start, stop = np.array([0, 0, 5, 76, 30]), np.array([1, 77, 37, 77, 62])
    assert range_min(values, start, stop).tolist() == [values[a:b].min() for a, b in zip(start, stop, strict=True)]
