"""Language-model scores by prediction by partial matching, and a smoothed word unigram beside them.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that followed them in training
(a NUL byte ends a text, and stands before its first byte). In a context a byte seen there n times of t, among q different
ones, has probability n / (t + q); the escape, q / (t + q), goes to the other bytes, in proportion to their probability in
the context one byte shorter with the symbols already seen excluded. Below the empty context all 256 bytes are equal.

Every context of the training texts counts. Their table stays in Spark: ``probabilities`` has the probability of each byte
that follows each full context anywhere in the texts, made order by order in joins of at most 256 rows a key.
Contexts that make up at least ``support`` of all positions, at most 1 / support (8,192) an order, also stand in a trie that
tasks hold: 60 MB at most. Its rows are exact, as each suffix of such a context is at least as frequent, and its ``ORDER`` rounds
of look-ups over all bytes at once spare the others' search. The other contexts' probabilities go to the tasks whole if there are at
most ``SENT_GRAMS``, and else by a join: each chunk of texts meets those of its own different grams.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from equiloom.llm.common import stored

ORDER = 4
SUPPORT = 1 / 8192
#: Words with this share of all tokens or more are at most 200,000; each task gets those of up to 64 bytes.
FREQUENT, FREQUENT_BYTES = 1 / 200_000, 64
END = b""
CHUNK_BYTES = 1 << 21
HELD_WORDS, HELD_GRAMS = 1_000_000, 4_000_000
#: Probabilities sent to every task (12 bytes each), and bytes of text that meet their own in one task if there are more.
SENT_GRAMS, GROUP_BYTES = 4_000_000, 1 << 23


@dataclass
class Trie:
    """Row 0 is the empty context. ``step`` leads to the row of the longest known context after one more byte.

    Rows from ``full`` on are ``contexts``, those of the whole order.
    """

    log10: np.ndarray
    step: np.ndarray
    order: int
    full: int
    contexts: np.ndarray


def build(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
    """From (context, byte, count) arrays of orders 0, 1, ...; a context is its bytes as one number."""
    order = len(entries) - 1
    rows: list[dict[int, int]] = []
    tables, steps, first = [np.full(256, 1 / 256)], [], 0
    log, base = [], np.full(256, 1 / 256)
    for k, (context, byte, count) in enumerate(entries):
        found, where = np.unique(context, return_inverse=True)
        if k == 0 and not len(found):
            return Trie(np.log10(base)[None].astype(np.float32), np.zeros((1, 256), np.int32), 0, 0, found)
        counts = np.zeros((len(found), 256))
        np.add.at(counts, (where, byte), count)
        short = found & np.uint64((1 << 8 * max(k - 1, 0)) - 1)
        suffix = np.array([rows[k - 1][int(c)] for c in short], np.int64) if k else np.zeros(1, np.int64)
        lower = log[k - 1][suffix - (first - len(log[k - 1]))] if k else np.tile(base, (len(found), 1))
        seen = counts > 0
        total, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        escape = np.where(kinds == 256, 0, kinds / (total + kinds))
        rest = np.where(seen, 0, lower)
        own = counts / np.where(kinds == 256, total, total + kinds)
        log.append(np.where(seen, own, escape * rest / np.maximum(rest.sum(axis=1, keepdims=True), 1e-300)))
        rows.append({int(c): first + n for n, c in enumerate(found)})
        if k:
            parents = np.array([rows[k - 1].get(int(c >> np.uint64(8)), -1) for c in found], np.int64)
            before = first - len(steps[k - 1])
            held = parents >= 0
            steps[k - 1][parents[held] - before, (found & np.uint64(255)).astype(np.int64)[held]] = (np.arange(len(found)) + first)[held]
        if k < order:
            # A byte that leads no further leads where it does from the context one byte shorter.
            steps.append(steps[k - 1][suffix - (first - len(steps[k - 1]))].copy() if k else np.zeros((1, 256), np.int32))
        first += len(found)
    return Trie(np.log10(np.maximum(np.vstack(log), 1e-300)).astype(np.float32), np.vstack(steps or [np.zeros((1, 256), np.int32)]), order, first - len(found), found)


def padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, ``order`` NULs before and one after each; the places that count; the first such place of each text."""
    joined = np.frombuffer(b"".join(b"\0" * order + t + b"\0" for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes + order) - sizes
    real = np.ones(len(joined), bool)
    real[(starts[:, None] - 1 - np.arange(order)).ravel()] = False
    return joined, real, np.cumsum(sizes) - sizes


def grams_at(joined: np.ndarray, order: int) -> np.ndarray:
    """At each place its byte and the ``order`` before it as one number."""
    gram = np.zeros(len(joined), np.uint64)
    for back in range(order, -1, -1):
        shifted = np.r_[np.zeros(back, np.uint8), joined[:len(joined) - back]]
        gram = gram << np.uint64(8) | shifted
    return gram


def placed(trie: Trie, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, trie rows and counting places of ``texts`` in one, the first such place of each text."""
    joined, real, firsts = padded(texts, trie.order)
    at = np.zeros(len(joined), np.int32)
    for _ in range(trie.order):
        at[1:] = trie.step[at[:-1], joined[:-1]]
        at[0] = 0
    return joined, at, real, firsts


def missed_grams(trie: Trie, texts: list[bytes]) -> np.ndarray:
    """The different grams whose context is not in the trie."""
    joined, at, real, _ = placed(trie, texts)
    return np.unique(grams_at(joined, trie.order)[real & (at < trie.full)])


def code_lengths(trie: Trie, texts: list[bytes], grams: np.ndarray, log10: np.ndarray) -> np.ndarray:
    """log10 probability of each text and its end; ``grams``, sorted, and ``log10`` have what the trie has not."""
    joined, at, real, firsts = placed(trie, texts)
    value = trie.log10[at, joined].astype(np.float64)
    missed = np.flatnonzero(real & (at < trie.full))
    if len(missed):
        wanted = grams_at(joined, trie.order)[missed]
        found = np.searchsorted(grams, wanted)
        if found.max() >= len(grams) or not np.array_equal(grams[found], wanted):
            raise ValueError("a text has changed while it was scored")
        value[missed] = log10[found]
    return np.add.reduceat(value[real], firsts)


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-case texts in runs of some ``CHUNK_BYTES``, with the number of the first."""
    start, held, size = 0, [], 0
    for n, text in enumerate(texts):
        held.append((text or b"").lower())
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield start, held
            start, held, size = n + 1, [], 0
    if held:
        yield start, held


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    joined, real, _ = padded(texts, order)
    return np.unique(grams_at(joined, order)[real], return_counts=True)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    gram, count = gram[order], count[order]
    head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[head], np.add.reduceat(count, head)


def counted(docs: DataFrame, order: int, training: Column | None = None) -> DataFrame:
    """(word, gram, n): how often each word, and each byte after ``order`` bytes, occurs. Tasks add up before the shuffle.

    Of rows that are not ``training`` only the grams come, and count zero.
    """
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def word_rows() -> Iterator[pa.RecordBatch]:
            keys, values = list(words), list(words.values())
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array(values[at:at + 100_000], pa.int64())], schema=schema)
            words.clear()

        def gram_rows() -> Iterator[pa.RecordBatch]:
            if grams:
                keys, values = _merged(grams)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.astype(np.int64)), pa.array(values.astype(np.int64))], schema=schema)
            grams.clear()

        for batch in batches:
            learnt = batch.column(1).to_pylist()
            for start, texts in slices(batch.column(0).to_pylist()):
                which = learnt[start:start + len(texts)]
                for own in (True, False):
                    part = [t for t, w in zip(texts, which, strict=True) if w == own]
                    if part:
                        gram, n = _grams(part, order)
                        grams.append((gram, n * own))
                    if own and part:
                        for text in part:
                            words.update(text.split())
                        words[END] += len(part)
                if sum(len(g) for g, _ in grams) > HELD_GRAMS:
                    grams[:] = [_merged(grams)]
                    if len(grams[0][0]) > HELD_GRAMS // 2:
                        yield from gram_rows()
                if len(words) > HELD_WORDS:
                    yield from word_rows()
        yield from word_rows()
        yield from gram_rows()

    return docs.select(F.col("text").cast("binary"), F.lit(True) if training is None else training).mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def trained_trie(grams: DataFrame, order: int, support: float) -> Trie:
    """``grams``: (gram, n). Only contexts with enough support, a bounded number, come to the driver."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    nodes = grams.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("order"), F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("context")) for k in range(order + 1)))).alias("at"),
        F.col("gram").bitwiseAND(F.lit(255)).alias("byte"), "n",
    ).groupBy("at.order", "at.context", "byte").agg(F.sum("n").alias("n"))
    nodes = stored(nodes, "contexts")
    # At most (order + 1) / support rows.
    wide = nodes.groupBy("order", "context").agg(F.sum("n").alias("all")).where(F.col("all") >= total * support).drop("all")
    kept = nodes.join(F.broadcast(wide), ["order", "context"]).toArrow()
    columns = [kept.column(c).to_numpy() for c in ("order", "context", "byte", "n")]
    which = columns[0]
    return build([tuple(c[which == k].astype(t) for c, t in zip(columns[1:], (np.uint64, np.int64, np.int64), strict=True)) for k in range(order + 1)])


def probabilities(grams: DataFrame, order: int) -> DataFrame:
    """(gram, p) of every gram of (gram, n), from all contexts. A gram of n = 0 was not learnt from."""
    lower, known = None, F.col("n") > 0
    for k in range(order + 1):
        # The lowest k + 1 bytes of a gram are its byte and its context of order k; a byte less is the next shorter context's.
        rows = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        if k:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(lower, "short")
        else:
            rows = rows.withColumn("base", F.lit(1 / 256))
        # A context has at most 256 rows.
        here = Window.partitionBy(F.shiftright("gram", 8))
        rows = rows.select(
            "gram", "n", "base", F.sum("n").over(here).alias("total"), F.sum(known.cast("long")).over(here).alias("kinds"),
            (1 - F.sum(F.when(known, F.col("base")).otherwise(0.0)).over(here)).alias("rest"),
        )
        own = F.col("n") / F.when(F.col("kinds") == 256, F.col("total")).otherwise(F.col("total") + F.col("kinds"))
        escaped = F.col("kinds") / (F.col("total") + F.col("kinds")) * F.col("base") / F.col("rest")
        p = F.when(known, own).when(F.col("kinds") == 0, F.col("base")).otherwise(escaped)
        lower = stored(rows.select(F.col("gram").alias("short"), p.alias("base")), "probabilities")
    return lower.toDF("gram", "p")


def grouped(source: DataFrame) -> DataFrame:
    """``source`` (doc_id, text, training) with the number of a chunk of some ``GROUP_BYTES`` of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            numbers = []
            for length in pc.binary_length(batch.column("text")).to_pylist():
                if size and size + length >= GROUP_BYTES:
                    size, number = 0, number + 1
                size += length + 1
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["chunk", "doc_id", "text", "training"])

    return source.mapInArrow(work, "chunk long, doc_id long, text binary, training boolean")


def missing_probabilities(grams: DataFrame, trie: Trie, order: int) -> DataFrame:
    """(gram, log10) of each gram whose context of the whole order is not in the trie."""
    if not trie.full:
        return grams.select("gram", F.lit(0.0).alias("log10")).limit(0)
    contexts = grams.sparkSession.createDataFrame(pa.table({"context": pa.array(trie.contexts.astype(np.int64))}))
    held = probabilities(grams, order).withColumn("context", F.shiftright("gram", 8)).join(F.broadcast(contexts), "context", "left_anti")
    return stored(held.select("gram", F.log10("p").alias("log10")), "missing")


def _columns(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams and their log10 probabilities."""
    gram, log10 = found.column(0).to_numpy().astype(np.uint64), found.column(1).to_numpy().astype(np.float32)
    order = np.argsort(gram)
    return gram[order], log10[order]


def lm_scores(docs: DataFrame, training: Column, order: int = ORDER, support: float = SUPPORT, frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    ``training`` says which rows are learnt from. Texts are lower-cased (A-Z). Tokens are words between ASCII white space, and
    one end for each text; base_score is the sum of their log10 ((c + 0.5) / (N + 0.5 (V + 1))). A null text is empty. Without
    training rows all bytes are equally likely and N = V = 0. Repeated rows are learnt from, and scored, once each.
    Words too rare for the tasks' table meet their counts in a join, each text's sum first added up by task.
    ``support`` and ``frequent`` say what tasks hold in tables, and change no result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = stored(counted(source, order, F.col("training")), "counts")
    words = counts.where("word is not null").select("word", F.col("n").alias("c"))
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    grams = counts.where("gram is not null").select("gram", "n")
    trie = trained_trie(grams.where("n > 0"), order, support)
    missing = missing_probabilities(grams, trie, order)
    mass = tokens + 0.5 * (kinds + 1)
    # Long words are told by a digest after a blank, which no word holds, so that the table's bytes are bounded whatever their length.
    name = F.when(F.length("word") <= FREQUENT_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    common = words.where(F.col("c") >= tokens * frequent).select(name.alias("word"), "c").collect()
    whole = missing.count() <= SENT_GRAMS
    known = _columns(missing.toArrow()) if whole else None
    sent = spark.sparkContext.broadcast((trie, known, {bytes(r["word"]): float(np.log10((r["c"] + 0.5) / mass)) for r in common}))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch], first: int, missing: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        model, _, table = sent.value
        number = itertools.count(first)
        for batch in batches:
            ids, trained = batch.column("doc_id").to_pylist(), batch.column("training").to_pylist()
            for start, texts in slices(batch.column("text").to_pylist()):
                lengths = code_lengths(model, texts, *missing)
                heads, rare = [], []
                for i, text in enumerate(texts):
                    row, found = next(number), text.split()
                    found.append(END)
                    values = list(map(table.get, found))
                    missed = Counter(w for w, v in zip(found, values, strict=True) if v is None)
                    known = [v for v in values if v is not None]
                    for word in [w for w in missed if len(w) > FREQUENT_BYTES]:
                        if (value := table.get(b" " + hashlib.md5(word, usedforsecurity=False).digest())) is not None:
                            known += [value] * missed.pop(word)
                    # A word has no blank, so the head's key is no word, and heads spread over all partitions.
                    heads.append((row, ids[start + i], not trained[start + i], b" %d" % row, 0, len(found), len(known), sum(known), float(lengths[i])))
                    rare += [(row, None, None, w, n, 0, 0, 0.0, 0.0) for w, n in missed.items()]
                columns = zip(*heads, *rare, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scored(batches, TaskContext.get().partitionId() << 33, sent.value[1])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value[0]
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            for chunk in np.unique(chunks):
                for _, texts in slices(batch.filter(pa.array(chunks == chunk)).column("text").to_pylist()):
                    gram = missed_grams(model, texts).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk)), pa.array(gram)], names=["chunk", "gram"])

    def met(key: tuple[pa.Scalar, ...], texts: pa.Table, own: pa.Table) -> pa.Table:
        # Chunks are numbered in steps of one from a task's partition number << 33, and have fewer than 2^24 texts.
        chunk = key[0].as_py()
        first = (chunk >> 33 << 43) + ((chunk & ((1 << 33) - 1)) << 24)
        return pa.Table.from_batches(scored(texts.to_batches(), first, _columns(own.select(["gram", "log10"]))), schema)

    source = source.select("doc_id", F.col("text").cast("binary").alias("text"), "training")
    kind = "row long, doc_id long, held_out boolean, word binary, n long, n_tokens long, n_known long, base double, score double"
    if whole:
        rows = source.mapInArrow(work, kind)
    else:
        chunks = stored(grouped(source), "chunks")
        own = chunks.select("chunk", "text").mapInArrow(wanted, "chunk long, gram long").distinct().join(missing, "gram").select("chunk", "gram", "log10")
        rows = stored(chunks.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(met, kind), "scored")
    each = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(mass))
    return (
        rows.join(words, "word", "left").groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.col("base") + each).alias("base_score"), F.sum("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")
    )
