"""Decontamination against brute force."""

import re

import numpy as np

from equiloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    found, hit, names = words(text), set(), set()
    for item_id, body in items:
        if item_id is None:
            continue
        own = words(body)
        for i in range(max(1, len(own) - size + 1)) if own else ():
            window = own[i:i + size]
            for at in range(len(found) - len(window) + 1):
                if found[at:at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    names.add(str(item_id))
    return len(found), sorted(hit), sorted(names)


ITEMS = [(10, ITEM), (9, "é1 short item"), (9, ITEM.upper() + " nu xi"), (8, None), (7, ""), (None, "never reported at all"), (6, "beta gamma"), (2, "one")]
DOCS = [
    (1, f"before -- {ITEM.lower()} after"), (2, None), (3, ""), (4, "É1 short item"), (4, "é1\n<SHORT>  item, one"), (None, ITEM), (5, " ".join(ITEM.split()[:9])), (6, "one " * 400 + ITEM), (7, "xbeta gamma beta gammax beta gamma"),
    (8, "never reported at all"), (9, "\U0001F600 beta\tgamma \U0001F600"),
]


def test_hits(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for at_once in (250_000, 2):
        rows = decontaminate.with_hits(docs, items, at_once=at_once).collect()
        assert len(rows) == len(DOCS)
        for row in rows:
            assert (row["hits"]["n_words"], sorted(row["hits"]["hit_words"]), list(row["hits"]["items"])) == brute(row["text"], ITEMS)
    rows = decontaminate.with_hits(docs, items).collect()
    for row in rows:
        for start, end in row["hits"]["spans"]:
            assert words(row["text"][start:end]) and (start == 0 or not WORD.match(row["text"].lower()[start - 1]))
        covered = [w for start, end in row["hits"]["spans"] for w in words(row["text"][start:end])]
        assert len(covered) == len(row["hits"]["hit_words"])


def test_blocks_are_held_one_at_a_time(spark, monkeypatch):
    items = spark.createDataFrame([(n, "shared words stand in every item") for n in range(7)] + [(90, ITEM)], "item_id long, text string")
    placed, count = decontaminate.in_blocks(items, at_once=3)
    sizes = [r["count"] for r in placed.groupBy("block").count().collect()]
    assert len(sizes) == count > 2 and max(sizes) == 3
    live, most = set(), []
    made, real = [], decontaminate.hits_of

    def watched(sent, text):
        live.add(sent)
        most.append(len(sent.value))
        assert len(live) == 1  # the one before has gone
        made.append(sent)
        gone = sent.destroy
        sent.destroy = lambda *a: (live.discard(sent), gone(*a))
        return real(sent, text)

    monkeypatch.setattr(decontaminate, "hits_of", watched)
    docs = spark.createDataFrame([(1, "x shared words stand in every item y"), (2, ITEM + " z"), (2, ITEM + " z"), (3, None)], "doc_id long, text string")
    rows = decontaminate.with_hits(docs, items, at_once=3).collect()
    assert len(made) == count and max(most) <= 3
    assert sorted((r["doc_id"], tuple(r["hits"]["items"])) for r in rows) == [(1, tuple("0123456")), (2, ("90",)), (2, ("90",)), (3, ())]


def test_columns_stay(spark):
    docs = spark.createDataFrame([(i, t, 0, "h") for i, t in DOCS], "doc_id long, text string, hits__ int, hits string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, t in DOCS if not brute(t, [(1, ITEM)])[1])


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    found = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(found) == len(DOCS) and not any(r["contaminated"] for r in found)


def test_offsets_count_characters():
    text = "é, ΑΒ x"
    assert decontaminate.offsets(text.encode(), np.array([0, 2])) == [(0, 1), (6, 7)]
