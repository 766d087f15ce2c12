"""Prefix trie of conversations: every distinct sequence of first turns is a node, counted without building the trie in one place.

A conversation's turns are cut into pieces of ``DEPTH`` turns, so that no row, key or task holds a whole long one. A prefix is known
by its depth and the exclusive or of 128-bit hashes of its (place, turn) pairs, which adds up over pieces. Distinct pieces, sorted by where they
start and what they hold, are dealt to tasks by range: a shard. In a shard they form a forest, written as balanced parentheses; ``findclose``
delimits a node's subtree, the rank of leaf pairs counts its leaves, and cumulative arrays over nodes and pieces give members and savings.
All sums are over pieces or over nodes newly opened, so a spine that several shards share (its nodes are told by the pieces next to the
shard) is merged by adding up. What lies below a piece's end comes as sums by conversation from the pieces further down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.functions.ranking import numbered
from equiloom.llm.common import stored
from equiloom.llm.parentheses import Parentheses, range_min
from equiloom.session import checkpointed

#: Turns of a piece.
DEPTH = 32
#: Rows of a conversation that meet its own figures under one key, as a power of two.
SEGMENT_BITS = 12
#: Characters of roles and texts by which rows of the same turn are put in order before their digest decides.
ORDER_CHARS = 256
#: Members hashed as one text.
IDS_AT_ONCE = 1 << 16

Path = tuple[tuple[int, int, int], list[tuple[int, int]]]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, row_no, digest, chars) of every turn with a conv_id; row_no runs through the whole table by conversation.

    Turns go by turn (nulls first), then role, text and digest, role and text by their first ``ORDER_CHARS`` characters; repeated rows are turns of
    their own. Null roles and texts are empty. Rows without a conv_id are in no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), "turn", F.left(role, F.lit(ORDER_CHARS)).alias("role"), F.left(text, F.lit(ORDER_CHARS)).alias("text"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("chars"),
        # Equal rows may go to several ranges: which is which does not matter.
        F.monotonically_increasing_id().alias("copy"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("digest"), F.col("copy")]
    return numbered(rows, order).select("conv_id", F.col("row_no"), "digest", "chars")


def rebuilt(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, chars), (conv_id, depth)): turns of the rebuilt conversations, and every conversation with its number of turns.

    Conversation c begins with the first h turns of c - c % block and goes on with its own after the first h; h = crc32(c as text) % most.
    """
    name = F.col("conv_id")
    of = turns.groupBy("conv_id").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    of = of.select("conv_id", (name - name % block).alias("base"), (F.crc32(name.cast("string").cast("binary")) % most).alias("h"), "first", "n")
    bases = of.where(F.col("base") == name).select("base", "n")
    of = of.join(bases.withColumnRenamed("n", "base_n"), "base", "left")
    of = stored(of.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "conversations")
    # Key and segment of the row number: a very long conversation is many keys.
    segments = of.select("*", F.explode(F.sequence(F.shiftright("first", SEGMENT_BITS), F.shiftright(F.col("first") + F.col("n") - 1, SEGMENT_BITS))).alias("segment"))
    rows = turns.withColumn("segment", F.shiftright("row_no", SEGMENT_BITS)).join(segments, ["conv_id", "segment"])
    rows = stored(rows.select("conv_id", "base", "h", "taken", (F.col("row_no") - F.col("first") + 1).alias("place"), "digest", "chars"), "turns")
    own = rows.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars")
    # At most ``most - 1`` rows a base, met by the conversations of its block only.
    heads = rows.where((F.col("base") == name) & (F.col("place") < most)).select("base", "place", "digest", "chars")
    taken = of.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("place <= taken")
    every = own.unionByName(taken.select("conv_id", F.col("place").alias("depth"), "digest", "chars"))
    return every, of.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))


def pieces(turns: DataFrame, conversations: DataFrame, size: int = DEPTH) -> DataFrame:
    """One row for each piece of a conversation: where it starts (s1, s2, s_chars), its path and chars, its end (e1, e2), t_chars of the whole conversation, and whether it goes on."""
    turn = F.struct("depth", *(F.xxhash64(F.lit(n), "depth", "digest").alias(f"h{n}") for n in (1, 2)), "chars")
    level = F.floor((F.col("depth") - 1) / size).cast("int")
    # At most ``size`` rows a key.
    cut = turns.select("conv_id", level.alias("level"), turn.alias("turn")).groupBy("conv_id", "level").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.h1").alias("x1"), F.bit_xor("turn.h2").alias("x2"), F.sum("turn.chars").alias("sum"))
    # What ends where a piece could start has an empty one there, so that pieces from a start are those of all members of its node.
    none = conversations.where(F.col("depth") % size == 0).select("conv_id", (F.col("depth") / size).cast("int").alias("level"), F.array().cast(cut.schema["turns"].dataType).alias("turns"), *(F.lit(0).cast("long").alias(c) for c in ("x1", "x2", "sum")))
    by_level = Window.partitionBy("conv_id").orderBy("level")
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")

    def carried(total: Column) -> Column:
        return F.coalesce(total.over(before), F.lit(0).cast("long"))

    rows = cut.unionByName(none).select(
        "*", carried(F.bit_xor("x1")).alias("s1"), carried(F.bit_xor("x2")).alias("s2"), carried(F.sum("sum")).alias("s_chars"),
        F.sum("sum").over(whole).alias("t_chars"), (F.max("level").over(whole) > F.col("level")).alias("goes_on"))
    return rows.select(
        "conv_id", "level", "s1", "s2", "s_chars", F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"))).alias("path"),
        F.col("turns.chars").alias("chars"), F.col("s1").bitwiseXOR(F.col("x1")).alias("e1"), F.col("s2").bitwiseXOR(F.col("x2")).alias("e2"), "t_chars", "goes_on")


ORDER = ("level", "s1", "s2", "path")
#: What a task gets of each distinct piece: sums are over the conversations that have it.
GROUPED = ("level", "s1", "s2", "s_chars", "path", "chars", "conv_id", "members", "t_chars", "chars_below", "leaves_below", "goes_on")


def _distinct(rows: DataFrame) -> DataFrame:
    """From pieces with chars_below and leaves_below; copies are counted on every task before the shuffle."""
    return rows.groupBy("level", "s1", "s2", "s_chars", "path", "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), *(F.sum(c).alias(c) for c in ("t_chars", "chars_below", "leaves_below")), F.max("goes_on").alias("goes_on"))


def _sharded(groups: DataFrame) -> tuple[DataFrame, dict[int, tuple[Path | None, Path | None]]]:
    """Distinct pieces in order, one range a task, with its number as ``shard``; and for each shard the pieces next to it on both sides.

    The driver gets two pieces, of at most DEPTH hashes each, for each task.
    """
    placed = checkpointed(groups.select(*GROUPED).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("shard", F.spark_partition_id()))
    key = F.struct(*ORDER)
    ends = sorted(placed.groupBy("shard").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect())

    def path(row) -> Path:
        return (row["level"], row["s1"], row["s2"]), [tuple(h) for h in row["path"]]

    found = {}
    for i, row in enumerate(ends):
        found[row["shard"]] = (path(ends[i - 1]["high"]) if i else None, path(ends[i + 1]["low"]) if i + 1 < len(ends) else None)
    return placed, found


def _common(a: Path | None, b: Path | None) -> int:
    """Turns that two pieces share from their start, -1 if they start apart."""
    if a is None or b is None or a[0] != b[0]:
        return -1
    same = [x == y for x, y in zip(a[1], b[1], strict=False)]
    return same.index(False) if False in same else len(same)


class Shard:
    """The forest of a task's distinct pieces; nodes are numbered in preorder, each group of pieces under a root for where it starts."""

    def __init__(self, table: pa.Table, next_to: dict[int, tuple[Path | None, Path | None]], size: int):
        self.size = size
        columns = {name: table.column(name).combine_chunks() for name in table.column_names}
        self.col = {name: columns[name].to_numpy(zero_copy_only=False) for name in columns if name not in ("path", "chars")}
        path, chars = columns["path"].flatten(), columns["chars"].flatten()
        self.h = [path.field(n).to_numpy(zero_copy_only=False) for n in (0, 1)]
        self.chars = chars.to_numpy(zero_copy_only=False)
        self.length = columns["path"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.offset = np.cumsum(self.length) - self.length
        before, after = next_to[int(self.col["shard"][0])]
        #: Turns shared with the pieces outside, on the left and on the right; -1: not even the start.
        self.left, self.right = _common(before, self._path(0)), _common(self._path(len(self.length) - 1), after)
        self.extended = self.right == self.length[-1]
        self._open()

    def _path(self, i: int) -> Path:
        own = slice(self.offset[i], self.offset[i] + self.length[i])
        return tuple(int(self.col[c][i]) for c in ("level", "s1", "s2")), list(zip(self.h[0][own].tolist(), self.h[1][own].tolist(), strict=True))

    def _open(self) -> None:
        length, offset, count = self.length, self.offset, len(self.length)
        same = np.zeros(count, bool)
        same[1:] = np.logical_and.reduce([self.col[c][1:] == self.col[c][:-1] for c in ("level", "s1", "s2")])
        piece = np.repeat(np.arange(count), length)
        place = np.arange(len(piece)) - offset[piece]
        last = np.maximum(piece - 1, 0)
        there = same[piece] & (place < length[last])
        other = np.where(there, offset[last] + place, 0)
        equal = there & (self.h[0] == self.h[0][other]) & (self.h[1] == self.h[1][other]) if len(piece) else there
        shared = length.copy()
        np.minimum.at(shared, piece, np.where(equal, length[piece], place))
        shared[~same] = -1
        opened = length - shared
        closed = np.append(0, length[:-1] - shared[1:])
        #: For each node: the piece that opens it, its turns below the root, its turn among all turns.
        self.first = np.cumsum(opened) - opened
        self.piece = np.repeat(np.arange(count), opened)
        self.depth = np.arange(len(self.piece)) - self.first[self.piece] + shared[self.piece] + 1
        self.end = self.first + opened - 1
        runs = np.stack([closed, opened], axis=1).ravel()
        bits = np.append(np.repeat(np.tile([0, 1], count), runs), np.zeros(length[-1] + 1, np.int64))
        self.tree = Parentheses(bits)
        self.shared, path = shared, np.zeros(self.size + 1, np.int64)
        self.parent = np.arange(-1, len(self.piece) - 1)
        for i in range(count):
            top = shared[i] + 1
            self.parent[self.first[i]] = path[top - 1] if top else -1
            path[top:length[i] + 1] = np.arange(self.first[i], self.end[i] + 1)
        #: Nodes that another shard on the left has opened, and nodes some of whose subtree lies in another shard.
        self.fresh = np.ones(len(self.piece), bool)
        self.fresh[:self.left + 1] = False
        self.partial = ~self.fresh
        self.partial[path[:self.right + 1]] = True
        self.turn = np.where(self.depth > 0, offset[self.piece] + self.depth - 1, 0)
        self.new_chars = np.where(self.fresh & (self.depth > 0), self.chars[self.turn] if len(self.chars) else 0, 0)

    def by_piece(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece: characters of the nodes it opens, and one if it ends in a leaf."""
        chars = np.add.reduceat(self.new_chars, self.first)
        closes = self.tree.findclose(self.tree.opens[self.end])
        leaf = (closes == self.tree.opens[self.end] + 1) & ~self.col["goes_on"]
        leaf[-1] &= not self.extended
        return chars, leaf.astype(np.int64)

    def nodes(self) -> pa.RecordBatch:
        col, tree, opens = self.col, self.tree, self.tree.opens
        closes = tree.findclose(opens)
        number = np.arange(len(opens))
        beyond = number + (closes - opens + 1) // 2
        start, stop = self.piece, np.searchsorted(self.end, beyond)

        def total(values: np.ndarray) -> np.ndarray:
            running = np.append(0, np.cumsum(values.astype(np.int64)))
            return running[stop] - running[start]

        running = np.append(0, np.cumsum(self.new_chars))
        members = total(col["members"])
        no_leaf = col["goes_on"].astype(np.int64)
        no_leaf[-1] |= self.extended
        leaves = tree.leaves(opens, closes) - total(no_leaf) + total(col["leaves_below"])
        chars_before = np.append(0, np.cumsum(self.chars))
        upper = np.where(self.depth > 0, col["s_chars"][start] + chars_before[self.turn] - chars_before[self.offset[start]], 0)
        saved = total(col["t_chars"]) - members * upper - (running[beyond] - running[number]) - total(col["chars_below"])
        children = np.bincount(self.parent[self.fresh & (self.parent >= 0)], minlength=len(opens))
        conv = range_min(col["conv_id"], start, stop)
        ids, parents = [], []
        for n in (0, 1):
            running = np.concatenate([np.zeros(1, np.int64), np.bitwise_xor.accumulate(self.h[n])])
            own = running[np.where(self.depth > 0, self.turn + 1, self.offset[start])] ^ running[self.offset[start]] ^ col[f"s{n + 1}"][start]
            ids.append(own)
            parents.append(own[np.maximum(self.parent, 0)])
        top = self.depth == 0
        # A root below the first level stands for a node of the level above, which has the rest.
        twin = top & (col["level"][start] > 0)
        out = {
            "depth": col["level"][start].astype(np.int64) * self.size + self.depth, "p1": ids[0], "p2": ids[1], "conv_id": conv, "n_convs": np.where(twin, 0, members), "n_children": children,
            "n_leaves": np.where(twin, 0, leaves), "saved_tokens": np.where(twin, 0, saved), "parent_conv_id": pa.array(conv[np.maximum(self.parent, 0)], mask=top), "q1": parents[0], "q2": parents[1],
            "partial": self.partial, "parent_partial": ~top & self.partial[np.maximum(self.parent, 0)],
        }
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))


NODE = "depth long, p1 long, p2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, q1 long, q2 long, partial boolean, parent_partial boolean"


def _below(cut: DataFrame, size: int) -> DataFrame:
    """(conv_id, level, chars_below, leaves_below) of pieces that go on: what the conversation itself opens further down, each node counted for the first that has it."""
    lower = cut.where("level > 0").withColumns({"chars_below": F.lit(0).cast("long"), "leaves_below": F.lit(0).cast("long")})
    placed, next_to = _sharded(_distinct(lower))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [b for b in batches if b.num_rows]:
            shard = Shard(pa.Table.from_batches(found), next_to, size)
            chars, leaf = shard.by_piece()
            yield pa.RecordBatch.from_arrays([pa.array(shard.col["conv_id"]), pa.array(shard.col["level"]), pa.array(chars), pa.array(leaf)], names=["conv_id", "level", "chars", "leaf"])

    opened = placed.mapInArrow(work, "conv_id long, level int, chars long, leaf long")
    further = Window.partitionBy("conv_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.where("goes_on or level > 0").select("conv_id", "level", "goes_on").join(opened, ["conv_id", "level"], "left")
    sums = (F.coalesce(F.sum(c).over(further), F.lit(0).cast("long")).alias(f"{name}_below") for c, name in (("chars", "chars"), ("leaf", "leaves")))
    return rows.select("conv_id", "level", "goes_on", *sums).where("goes_on").drop("goes_on")


def _ends(cut: DataFrame, size: int) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the nodes some conversations end at.

    A hash is a chain, so one task reads a node's members; they come in order, as texts of up to IDS_AT_ONCE numbers made
    by many tasks, and memory holds one such text.
    """
    ids = cut.where("not goes_on").select((F.col("level") * size + F.size("path")).cast("long").alias("depth"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in range(3)])
            convs = batch.column(3).to_numpy()
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            starts = [s for a, b in zip(np.append(0, cuts), np.append(cuts, len(convs)), strict=True) for s in range(a, b, IDS_AT_ONCE)]
            texts = [",".join(map(str, convs[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(convs)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(convs[starts]), pa.array(texts)], names=["depth", "p1", "p2", "conv_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())]))

        def close() -> None:
            if key is not None:
                done.append(dict(zip(("depth", "p1", "p2", "ends_sha256"), (*key, state.hexdigest()), strict=True)))

        for batch in batches:
            done = []
            for *names, text in zip(*(batch.column(n).to_pylist() for n in (0, 1, 2, 4)), strict=True):
                if names == key:
                    state.update(b",")
                else:
                    close()
                    key, state = names, hashlib.sha256()
                state.update(text.encode())
            yield packed()
        done = []
        close()
        yield packed()

    keys = ("depth", "p1", "p2")
    texts = ids.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id").mapInArrow(joined, "depth long, p1 long, p2 long, conv_id long, ids string")
    return texts.repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, size: int = DEPTH) -> DataFrame:
    """Every node of the trie of ``turns`` (conv_id, depth from 1, digest, chars); ``conversations`` (conv_id, depth) has all, turnless ones too, ids different;
    ``size`` is the number of turns of a piece.

    conv_id and depth name a node: the smallest member and its number of first turns. parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, characters of a node's last turn for each member but one) and ends_sha256 as told there. Without conversations there is no node.
    """
    cut = stored(pieces(turns, conversations, size), "pieces")
    going = cut.where("goes_on").join(_below(cut, size), ["conv_id", "level"])
    zero = F.lit(0).cast("long")
    rows = going.unionByName(cut.where("not goes_on").withColumns({"chars_below": zero, "leaves_below": zero}))
    placed, next_to = _sharded(_distinct(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := [b for b in batches if b.num_rows]:
            yield Shard(pa.Table.from_batches(found), next_to, size).nodes()

    nodes = stored(placed.mapInArrow(work, NODE), "nodes")
    # At most 2 * (size + 1) rows for each task that made them.
    spines = nodes.where("partial").groupBy((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).agg(F.min("conv_id").alias("spine"))
    parent = F.when(F.col("parent_partial"), F.col("spine")).otherwise(F.col("parent_conv_id"))
    merged = nodes.join(F.broadcast(spines), ["depth", "q1", "q2"], "left").groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.min(parent).alias("parent_conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    return merged.join(_ends(cut, size), ["depth", "p1", "p2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
