"""SimHash fingerprints and near-duplicate classes by a Gray-order hierarchical index.

Codes that differ in few bits must agree on one of ``limit + 1`` parts of their bits. Each code is therefore
filed under that many *upper nodes*, one for each part: the masked bit pattern it shares with the others there.
Below an upper node the codes are sorted by Gray rank, so that neighbours share most bits, and runs of them
form a tree: a node holds the bits all its codes share, less those its parent holds already. A search walks
down adding up differences, and leaves a whole group as soon as the sum passes the limit.

An upper node with too many codes is filed anew by a part of the bits that are still free. With 15 free bits
left a node has at most 2^15 different codes, so no node can outgrow a task whatever the data, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from equiloom.llm.common import partitions, stored

BITS = 64
FAN_OUT = 16
QUERIES_AT_ONCE = 2048
NODE_LIMIT = 1 << 15
SHINGLES_AT_ONCE = 1 << 18
ALL_ONES = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 for one without words. ASCII white space separates words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    total = max(1, len(found) - words + 1)
    digest, counts = xxhash.xxh64_intdigest, (min(SHINGLES_AT_ONCE, total - start) for start in range(0, total, SHINGLES_AT_ONCE))
    return majority(np.fromiter((digest(s, seed) for _, s in zip(range(n), shingles)), "<u8", n) for n in counts)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """Signed code of the bits that are set in over half the 64-bit hashes."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in pieces:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint as a long. A null text counts as one without words."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        seen: dict[bytes | None, int] = {}
        return pd.Series([seen[t] if t in seen else seen.setdefault(t, fingerprint(t)) for t in texts], dtype="int64")

    return docs.withColumn(name, prints(F.col(text).cast("binary")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def linked_within(codes: np.ndarray, group: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of codes of one group that differ in ``limit`` bits or fewer. The arrays are sorted by group, then Gray rank."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(codes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    # One entry a level, leaves first: bits all codes below share, their values, each group's first node and its number of nodes.
    levels = [(np.full(len(codes), ALL_ONES), codes, starts, sizes)]
    ands, ors = codes, codes
    while sizes.max() > 1:
        lower_starts, lower_sizes = levels[-1][2], sizes
        sizes = -(-lower_sizes // FAN_OUT)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        cut = lower_starts[owner] + (np.arange(len(owner)) - first[owner]) * FAN_OUT
        ands, ors = np.bitwise_and.reduceat(ands, cut), np.bitwise_or.reduceat(ors, cut)
        levels.append((~(ands ^ ors), ands, first, sizes))
    for begin in range(0, len(codes), QUERIES_AT_ONCE):
        query = np.arange(begin, min(begin + QUERIES_AT_ONCE, len(codes)))
        mask, bits, first, _ = levels[-1]
        node = first[of[query]]
        differ = np.bitwise_count((codes[query] ^ bits[node]) & mask[node]).astype(np.int64)
        near = differ <= limit
        query, node, differ = query[near], node[near], differ[near]
        for depth in range(len(levels) - 2, -1, -1):
            upper_mask, _, upper_first, _ = levels[depth + 1]
            mask, bits, first, counts = levels[depth]
            inside = (node - upper_first[of[query]]) * FAN_OUT
            children = np.minimum(FAN_OUT, counts[of[query]] - inside)
            step = np.arange(children.sum()) - np.repeat(np.cumsum(children) - children, children)
            inside = np.repeat(inside, children) + step
            parent, query, differ = (np.repeat(x, children) for x in (node, query, differ))
            node = first[of[query]] + inside
            differ = differ + np.bitwise_count((codes[query] ^ bits[node]) & mask[node] & ~upper_mask[parent])
            last = levels[0][2][of[query]] + (inside + 1) * FAN_OUT**depth - 1
            keep = (differ <= limit) & (last > query if depth == 0 else last >= query)
            query, node, differ = query[keep], node[keep], differ[keep]
        yield query, node


def forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (roots, each the smallest index of its tree) after the pairs are joined."""
    while True:
        one, two = parent[a], parent[b]
        apart = one != two
        if not apart.any():
            return parent
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(shorter := parent[parent], parent):
            parent = shorter


def _parts(fixed: int, count: int) -> list[int]:
    """``fixed`` with one more part of the free bits, for each of ``count`` even parts."""
    free = [1 << i for i in range(BITS) if not fixed >> i & 1]
    return [fixed | sum(free[i * len(free) // count:(i + 1) * len(free) // count]) for i in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(codes: DataFrame, limit: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Edges (a, b) that connect what any chain of links connects. ``codes``: one column, different 64-bit codes.

    Each task reports a spanning forest of the links under its upper nodes rather than all pairs.
    """
    def filed(rows: DataFrame, masks: list[int]) -> DataFrame:
        fixed = F.explode(F.array(*(F.lit(_signed(m)) for m in masks)))
        return rows.select("code", fixed.alias("fixed")).withColumn("pattern", F.col("code").bitwiseAND(F.col("fixed")))

    source = codes.toDF("code")
    masks, ready, rows = _parts(0, limit + 1), [], filed(source, _parts(0, limit + 1))
    while True:
        # At most count / node_limit upper nodes can be over the limit.
        heavy = rows.groupBy("fixed", "pattern").count().where(F.col("count") > node_limit).drop("count")
        if any(bin(m).count("1") < BITS - 15 for m in masks):
            heavy = stored(heavy, "heavy")
        else:
            heavy = heavy.limit(0)
        if heavy.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(heavy, ["fixed", "pattern"], "left_anti"))
        over = rows.join(heavy, ["fixed", "pattern"], "left_semi")
        deeper = [filed(over.where(F.col("fixed") == _signed(m)), _parts(m, limit + 1)) for m in masks]
        masks = [x for m in masks for x in _parts(m, limit + 1)]
        rows = deeper[0]
        for more in deeper[1:]:
            rows = rows.unionByName(more)
    members = ready[0].select("code", "fixed", "pattern")
    for more in ready[1:]:
        members = members.unionByName(more.select("code", "fixed", "pattern"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        code, fixed, pattern = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        code = code.astype(np.int64).view(np.uint64)
        order = np.lexsort((gray_rank(code), pattern, fixed))
        code, fixed, pattern = code[order], fixed[order], pattern[order]
        group = np.cumsum(np.r_[0, (fixed[1:] != fixed[:-1]) | (pattern[1:] != pattern[:-1])])
        shared = np.bincount(group)[group] > 1
        code, group = code[shared], group[shared]
        if not len(code):
            return
        root = np.arange(len(code))
        for a, b in linked_within(code, group, limit):
            root = forest(root, a, b)
        child = np.flatnonzero(root != np.arange(len(code)))
        signed = code.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[root[child]])], names=["a", "b"])

    count = partitions(codes.sparkSession)
    return members.repartition(count, "fixed", "pattern").mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node that can be reached.

    Large-star and small-star steps until only stars are left; each round is written to the shared folder. Minima are taken before any
    shuffle, and no neighbour list is ever gathered, so a node with very many edges is no burden to one task. Minima meet their edges in
    shuffles however few they are: a broadcast in every step of every round would pile up in the driver, which builds and keeps each of them.
    """
    def low(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("low")).hint("merge")

    def stars(tree: DataFrame) -> bool:
        """No node has two parents, or a parent and a child."""
        ends = tree.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(tree.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or ups > least").isEmpty()

    tree = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not stars(tree):
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both).withColumn("low", F.least("u", "low")).hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.distinct()
        small = large.join(low(large), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low(large).toDF("u", "v"))
        tree = stored(small.where("u <> v").distinct(), "edges")
    return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tree.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 2, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row; component_id is the smallest id reachable by links.

    A null text has fingerprint zero, like every text without words. A null id takes part in links but is never a
    component_id unless no row of its component has an id. Repeated rows are kept. An empty table gives an empty one.
    """
    prints = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "prints")
    codes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "codes")
    roots = components(links(codes.select("fingerprint"), limit, node_limit))
    member = codes.join(roots, codes.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = member.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(code: str):
    return F.lower(F.lpad(F.hex(F.col(code)), 16, "0"))
