"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark, one scan of every text.

Text is normalised to lower-case words one blank apart; a window is ``words`` of them in a row, or a whole item that has fewer.
Matches are mapped back to words and to byte and character offsets of the text as it was. The automaton is built
from at most ``WINDOWS_AT_ONCE`` windows; a larger benchmark is scanned for in that many windows at a time, and hits are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from equiloom.functions.ranking import numbered
from equiloom.llm.common import stored

#: Windows of one automaton; with windows of 10 words this is some 300 MB at most in a worker.
WINDOWS_AT_ONCE = 250_000
NOT_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z become a-z, other ASCII characters that are neither a letter nor a digit become blanks.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b in NOT_WORD else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


def automaton(windows: dict[str, list[int]]) -> ahocorasick.Automaton:
    """Each window, one blank before, between and after its words, with (number of words, item numbers)."""
    tree = ahocorasick.Automaton()
    for window, items in windows.items():
        tree.add_word(f" {window} ", (window.count(" ") + 1, items))
    tree.make_automaton()
    return tree


def scan(tree: ahocorasick.Automaton | None, text: bytes | None) -> tuple[int, np.ndarray, set[int]]:
    """Number of words, the numbers of the words hit, and the numbers of the items found."""
    found = words_of(text)
    none = np.empty(0, np.int64)
    if tree is None or not found:
        return len(found), none, set()
    line = f" {b' '.join(found).decode('utf-8', 'replace')} "
    hits = list(tree.iter(line))
    if not hits:
        return len(found), none, set()
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    ends = np.searchsorted(blanks, [end for end, _ in hits])  # the blank after word number k is number k + 1
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, ends, -1)
    np.add.at(change, ends - [size for _, (size, _) in hits], 1)
    return len(found), np.flatnonzero(np.cumsum(change[:-1]) > 0), set().union(*(items for _, (_, items) in hits))


def offsets(text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of runs of word numbers."""
    letter = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    characters = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    runs = np.split(words, np.flatnonzero(np.diff(words) > 1) + 1) if len(words) else []
    return [(int(characters[starts[r[0]]]), int(characters[ends[r[-1]]])) for r in runs]


def windows_of(benchmark: DataFrame, words: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item_id) of every item with an id and words, each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, items = [], []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(body)
                own = {b" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
                windows += own
                items += [item] * len(own)
            text_of = [w.decode("utf-8", "replace") for w in windows]
            yield pa.RecordBatch.from_arrays([pa.array(text_of, pa.string()), pa.array(items, pa.string())], names=["window", "item_id"])

    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string"), F.col(text).cast("binary"))
    return rows.mapInArrow(cut, "window string, item_id string").distinct()


def in_blocks(benchmark: DataFrame, words: int = 10, at_once: int = WINDOWS_AT_ONCE, **columns: str) -> tuple[DataFrame, int]:
    """(window, item_id, block), stored, and the number of blocks. A block has at most ``at_once`` of them; a window many items share may lie in several."""
    order = [F.col("window"), F.col("item_id")]
    rows = numbered(windows_of(benchmark, words, **columns), order, "number").withColumn("block", F.floor((F.col("number") - 1) / at_once).cast("int"))
    placed = stored(rows.drop("number"), "windows")
    return placed, (placed.agg(F.max("block")).first()[0] or 0) + 1


HITS = "n_words long, hit_words array<long>, items array<string>, spans array<struct<start: long, end: long>>"


def hits_of(sent: Broadcast, text: str) -> Column:
    """The words and items of one block's windows in a text; ``sent`` holds the block's (window, item_id)."""

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = sorted({item for _, item in sent.value})
        number, windows = {name: n for n, name in enumerate(names)}, {}
        for window, item in sent.value:
            windows.setdefault(window, []).append(number[item])
        tree = automaton(windows) if windows else None
        for texts in batches:
            rows = []
            for body in texts:
                count, hit, items = scan(tree, body)
                spans = [{"start": a, "end": b} for a, b in offsets(body, hit)] if len(hit) else []
                rows.append((count, hit.tolist(), sorted(names[i] for i in items), spans))
            yield pd.DataFrame(rows, columns=["n_words", "hit_words", "items", "spans"])

    return find(F.col(text).cast("binary"))


def with_hits(docs: DataFrame, benchmark: DataFrame, words: int = 10, text: str = "text", name: str = "hits", at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Adds a struct: n_words, hit_words (word numbers inside any occurrence of a window), items (ids as text, sorted), spans (start, end in characters).

    A null or wordless text has no words and no hits. Items without an id or without words take no part; an item
    that comes twice is one item. An empty benchmark hits nothing. A benchmark of several blocks of windows is scanned for block by block: driver
    and tasks hold one, and what each finds is written down and united by row.
    """
    spark = docs.sparkSession
    placed, count = in_blocks(benchmark, words, at_once)

    def sent(block: int) -> Broadcast:
        return spark.sparkContext.broadcast([(r["window"], r["item_id"]) for r in placed.where(F.col("block") == block).toLocalIterator()])

    if count == 1:
        return docs.withColumn(name, hits_of(sent(0), text))
    row = f"{name}__row"
    while row in docs.columns:
        row += "_"
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "scanned")
    found = None
    for block in range(count):
        held = sent(block)
        hits = rows.select(row, hits_of(held, text).alias("hits")).select(row, "hits.*")
        hits = stored(hits if found is None else hits.where(F.size("hit_words") > 0), "hits")  # the first counts every row's words
        held.destroy()
        found = hits if found is None else found.unionByName(hits)

    def united(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(field)))).alias(field)

    # At most one row a block and document.
    whole = found.groupBy(row).agg(F.max("n_words").alias("n_words"), united("hit_words"), united("items"), united("spans"))
    return rows.drop(name).join(whole.select(row, F.struct("n_words", "hit_words", "items", "spans").alias(name)), row).select(*(c for c in docs.columns if c != name), name)


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    rows = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    n_hit = F.size("hits.hit_words").cast("long")
    return rows.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 10) -> DataFrame:
    """``docs`` less the rows in which any window occurs; columns stay as they are."""
    name = "hits__"
    while name in docs.columns:
        name += "_"
    return with_hits(docs, benchmark, words, name=name).where(F.size(F.col(name)["hit_words"]) == 0).drop(name)
