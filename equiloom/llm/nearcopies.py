"""One row of each class of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash index first: texts whose fingerprints of five-word shingles are joined by links of ``BITS_APART`` bits or fewer in
the Gray-order index of ``simhash`` stand in a bucket. Pairs at 0.8 lie up to some 11 bits apart, further than that index can search a large table, so MinHash
bands add to it: texts that agree in all ``ROWS`` minima of one of ``BANDS`` bands stand in a bucket, too. A pair of
similarity s is missed by these with probability (1 - s^5)^32: 3 in a million at 0.8, less above. Only links that are verified on the shingles themselves
join texts, in two steps. First each text is held against the first one of a bucket, which makes one tree of a large group of near copies. Then
buckets that still hold several trees are cut into blocks of about ``BLOCK`` texts, of which any two meet in a unit of work: there each text looks
for texts of other trees, by size, then by agreement of minima, then by the shingles. Buckets of one tree are never opened, nor do blocks of
one tree meet, so that neither many copies nor many texts that share a passage gather in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from equiloom.llm.common import stored
from equiloom.llm.simhash import components, links, majority

WORDS = 5
#: Least similarity, as a fraction, so that equality is met without rounding.
LEAST = (4, 5)
#: Bits by which linked fingerprints may differ: with four parts of 16 bits an upper node has one in 65,536 of the codes.
BITS_APART = 3
BANDS, ROWS = 32, 5
#: Agreeing minima below which no pair is looked at: 0.8 gives 128 of 160 on average, and fewer than 100 once in a hundred million.
LEAST_AGREEING = 100
#: Texts of a block, and partners of one text that meet it under one key.
BLOCK, PARTNERS = 1024, 4096
SHINGLES_AT_ONCE = 1 << 12
_FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_FLIPS = np.random.default_rng(43).integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of a UTF-8 text; a text of fewer words is one shingle, one without words has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    total = max(1, len(found) - words + 1)
    joined = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, total))


def minima(found: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        low = np.minimum(low, ((found[None, at:at + SHINGLES_AT_ONCE] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> list[int]:
    """A signed hash of each band's number and minima."""
    keys = [xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def printed(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): digest of the text, code of its set of shingles, their number, its SimHash fingerprint, band keys (none without words), a byte of each minimum."""
    extra = {"digest": F.lit(b""), "code": F.lit(b""), "size": F.lit(0), "fingerprint": F.lit(0).cast("long"), "bands": F.array(F.lit(0).cast("long")), "signs": F.lit(b"")}
    schema = docs.select("doc_id", *(c.alias(n) for n, c in extra.items())).schema
    names = ["doc_id", *extra]

    def of(text: bytes | None) -> tuple[bytes, int, int, list[int], bytes]:
        found = shingles(text)
        low = minima(found)
        pieces = (found[at:at + SHINGLES_AT_ONCE] for at in range(0, len(found), SHINGLES_AT_ONCE))
        return xxhash.xxh3_128_digest(found.tobytes()), len(found), majority(pieces), band_keys(low) if len(found) else [], low.astype(np.uint8).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[bytes, int, int, list[int], bytes]] = {}
            out = []
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name not in seen:
                    seen[name] = of(text)
                out.append(seen[name])
            types = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([row[n] for row in out], kind) for n, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return docs.select("doc_id", digest("text").alias("digest"), F.col("text").cast("binary")).mapInArrow(work, schema)


def indexed(codes: DataFrame) -> DataFrame:
    """(code, band) for ``codes`` (code, fingerprint, bands) with words: the band is that of all fingerprints the SimHash index links."""
    prints = codes.where(F.size("bands") > 0).select("code", "fingerprint")
    roots = components(links(prints.select("fingerprint").distinct(), BITS_APART))
    linked = prints.join(roots, F.col("fingerprint") == F.col("node"), "left")
    return linked.select("code", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fingerprint")).alias("band"))


def buckets(codes: DataFrame) -> DataFrame:
    """(band, code, first, n): each code of a band that several have, with the band's smallest code and number of codes. Of bands of the same codes one stays.

    Bands are those of the SimHash index and of MinHash.
    """
    filed = indexed(codes).unionByName(codes.select("code", F.explode("bands").alias("band")))
    shared = filed.groupBy("band").agg(F.count("*").alias("n"), F.min("code").alias("first"), F.max("code").alias("last"), F.bit_xor(F.xxhash64("code")).alias("who")).where("n > 1")
    one = shared.groupBy("n", "first", "last", "who").agg(F.min("band").alias("band"))
    return filed.join(one.select("band", "first", "n"), "band").select("band", "code", "first", "n")


def shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(code, signs, shingles) for ``wanted`` (digest, code, signs). Equal texts are made one before they travel."""
    texts = docs.select(digest("text").alias("digest"), F.col("text").cast("binary").alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    schema = wanted.select("code", "signs", F.array(F.lit(0).cast("long")).alias("shingles")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingles(t).view(np.int64) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["code", "signs", "shingles"])

    return texts.join(wanted, "digest").select("code", "signs", "text").mapInArrow(work, schema)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, n) that are similar enough; n is at most the number of partners of b, which are dealt to slices."""
    cut = pairs.withColumn("slices", F.ceil(F.col("n") / PARTNERS)).withColumn("slice", F.pmod(F.xxhash64("a"), "slices"))
    one = cut.join(sets.select(F.col("code").alias("a"), F.col("shingles").alias("x")), "a")
    other = cut.select("b", "slices").distinct().join(sets.select(F.col("code").alias("b"), F.col("shingles").alias("y")), "b")
    other = other.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    common = F.size(F.array_intersect("x", "y"))
    return one.join(other, ["b", "slices", "slice"]).where(LEAST[1] * common >= LEAST[0] * (F.size("x") + F.size("y") - common)).select("a", "b")


def joined(sets: list[np.ndarray], signs: np.ndarray, tree: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of trees that link, enough to connect all that links connect. ``tree`` has a number from 0 for each set, ``signs`` a row."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(tree, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(tree[order])) + 1)
    left, free, found = np.ones(len(members), bool), np.ones(len(sets), bool), []
    for seed, own in enumerate(members):
        if not left[seed]:
            continue
        left[seed], free[own] = False, False
        queue = own.tolist()
        while queue:
            one = queue.pop()
            near = np.flatnonzero(free & (LEAST[1] * size >= LEAST[0] * size[one]) & (LEAST[0] * size <= LEAST[1] * size[one]))
            near = near[(signs[near] == signs[one]).sum(axis=1) >= LEAST_AGREEING]
            for other in near:
                if free[other]:
                    common = len(np.intersect1d(sets[one], sets[other], assume_unique=True))
                    if LEAST[1] * common >= LEAST[0] * (size[one] + size[other] - common):
                        found.append((seed, int(tree[other])))
                        left[tree[other]], free[members[tree[other]]] = False, False
                        queue += members[tree[other]].tolist()
            if not free.any():
                return found
    return found


def units(placed: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """From (band, code, tree): ((band, code, tree, big, slot) of bands with several trees, (band, big, slot, big2, slot2) of the blocks that have to meet).

    A tree with over ``block`` codes in a band has blocks of its own, told by ``big``; the other trees share blocks, whole, with ``big`` empty.
    """
    several = placed.groupBy("band").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).where("low <> high").select("band")
    inside = placed.join(several, "band", "left_semi")
    counted = inside.groupBy("band", "tree").agg(F.count("*").alias("n"))
    none, slots = F.lit(b""), F.ceil(F.col("n") / block)
    large = counted.where(F.col("n") > block).select("band", F.col("tree").alias("big"), slots.alias("slots"))
    small = counted.where(F.col("n") <= block).groupBy("band").agg(F.sum("n").alias("n")).select("band", slots.alias("slots"))
    # The few large trees of a band are named; small ones find their number of blocks by the band.
    sized = inside.join(large.withColumnRenamed("big", "tree"), ["band", "tree"], "left").withColumn("big", F.when(F.col("slots").isNotNull(), F.col("tree")).otherwise(none))
    sized = sized.join(small.withColumnRenamed("slots", "shared"), "band", "left")
    slot = F.pmod(F.xxhash64(F.when(F.col("slots").isNotNull(), F.col("code")).otherwise(F.col("tree"))), F.coalesce("slots", "shared"))
    filed = sized.select("band", "code", "tree", "big", slot.alias("slot"))

    def numbers(count: str, start: Column | None = None) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long") if start is None else start, F.col(count) - 1))

    within = small.select("band", none.alias("big"), numbers("slots").alias("slot"), none.alias("big2"), "slots").withColumn("slot2", numbers("slots", F.col("slot"))).drop("slots")
    mixed = large.join(small.withColumnRenamed("slots", "shared"), "band").select("band", "big", numbers("slots").alias("slot"), none.alias("big2"), "shared").withColumn("slot2", numbers("shared")).drop("shared")
    other = large.select("band", F.col("big").alias("big2"), F.col("slots").alias("slots2"))
    between = large.join(other, "band").where("big < big2").select("band", "big", numbers("slots").alias("slot"), "big2", "slots2").withColumn("slot2", numbers("slots2")).drop("slots2")
    return filed, within.unionByName(mixed).unionByName(between)


def links_between(placed: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between trees of ``placed`` (band, code, tree) that connect all that verified links inside a band connect."""
    filed, meet = units(placed, block)
    filed, meet = stored(filed, "filed"), stored(meet, "units")
    second = meet.select("band", F.col("big2").alias("own"), F.col("slot2").alias("at"), "big", "slot", "big2", "slot2").where("big <> big2 or slot <> slot2")
    sides = meet.select("band", F.col("big").alias("own"), F.col("slot").alias("at"), "big", "slot", "big2", "slot2").unionByName(second)
    rows = filed.select("band", F.col("big").alias("own"), F.col("slot").alias("at"), "code", "tree").join(sides, ["band", "own", "at"]).join(sets, "code")
    unit = ["band", "big", "slot", "big2", "slot2"]

    def work(table: pa.Table) -> pa.Table:
        tree = table.column("tree").combine_chunks().dictionary_encode()
        values = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in table.column("shingles")]
        signs = np.frombuffer(b"".join(table.column("signs").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        found = joined(values, signs, tree.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        name = tree.dictionary
        return pa.table([name.take(pa.array([p[i] for p in found], pa.int64())) for i in (0, 1)], names=["a", "b"])

    return rows.select(*unit, "tree", "signs", "shingles").groupBy(*unit).applyInArrow(work, "a binary, b binary").distinct()


def classes(docs: DataFrame, prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(code, class) of every code that links to another; codes reachable by links have one class."""
    codes = stored(prints.groupBy("code").agg(F.min("digest").alias("digest"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.first("signs").alias("signs")), "codes")
    filed = stored(buckets(codes.select("code", "fingerprint", "bands")), "buckets")
    wanted = codes.join(filed.select("code").distinct(), "code").select("digest", "code", "signs")
    sets = stored(shingled(docs, wanted), "shingles")
    # Each text against one other: the smallest of the first ones of its bands.
    first = filed.where("code <> first").groupBy(F.col("code").alias("a")).agg(F.min(F.struct("first", "n")).alias("f")).select("a", F.col("f.first").alias("b"), F.col("f.n").alias("n"))
    trees = stored(components(verified(first, sets)), "trees")
    placed = filed.join(trees.withColumnRenamed("node", "code"), "code", "left").select("band", "code", F.coalesce("root", "code").alias("tree"))
    more = stored(components(links_between(stored(placed, "placed"), sets, block)), "classes")
    every = trees.select(F.col("node").alias("code"), F.col("root").alias("tree")).unionByName(
        more.select(F.col("node").alias("code"), F.col("node").alias("tree")).join(trees.select(F.col("node").alias("code")), "code", "left_anti"))
    return every.join(more.withColumnRenamed("node", "tree"), "tree", "left").select("code", F.coalesce("root", "tree").alias("class"))


def one_of_each(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class of near copies, that of the smallest id (nulls last), then text digest; columns stay as they are.

    Texts make the classes, ids do not: rows with equal ids and unlike texts each stand for their own class. Null, empty and wordless texts
    are copies of each other, so one row of them stays. Extra columns of the same id and text are those of any such row.
    """
    key = "digest__"
    while key in docs.columns:
        key += "_"
    prints = stored(printed(docs), "prints")
    found = stored(classes(docs, prints, block), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")
    least = prints.groupBy("code").agg(F.min(row).alias("row")).join(found, "code", "left")
    least = least.groupBy(F.coalesce("class", "code").alias("class")).agg(F.min("row").alias("row"))

    def named(doc_id: Column, text: Column) -> Column:
        """Id and text as one value without nulls, on which rows meet and repeats go in one shuffle."""
        return F.concat(text, F.coalesce(doc_id.cast("string"), F.lit("none")).cast("binary"))

    kept = least.select(named(F.col("row.id"), F.col("row.digest")).alias(key))
    rows = docs.withColumn(key, named(F.col("doc_id"), digest("text")))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
