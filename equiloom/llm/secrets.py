"""Secret scan with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: an AND of clauses, each an OR of sets of trigrams
that must all occur. The index holds a posting (trigram, document) for every trigram some rule asks for. Intersecting postings
gives candidates, and only those are matched against the expression. A rule without mandatory trigrams matches every text.
Trigrams are taken from lower-case text on both sides, which can only add candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_
from re import _parser

from pyspark.sql import Column, DataFrame, functions as F

from equiloom.llm.common import stored

#: More candidates than this meet the documents in a shuffled join instead of a broadcast of 16 bytes each.
BROADCAST_ROWS = 250_000
ENUMERATED = 64
FEW = 8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap; those whose ``group`` is shorter than ``least`` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("passwd", "secret", "token")
) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
BASE = (
    Rule("assign", rf"""({ASSIGN})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run's first match is its longest one, so the least length may stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE

Clause = frozenset[frozenset[str]]


def _strings(node) -> set[str] | None:
    """All strings a node can match, if they are few."""
    name, value = str(node[0]), node[1]
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN":
        out = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < FEW:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= FEW else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[3])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > ENUMERATED:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> frozenset[Clause]:
    """Clauses that must all hold for a text to match; none if the expression has no mandatory trigram."""
    clauses: set[Clause] = set()

    def flush(run: set[str]) -> set[str]:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in sets:
            clauses.add(frozenset(s for s in sets if not any(t < s for t in sets)))
        return {""}

    run = {""}
    for node in _parser.parse(pattern):
        more = _strings(node)
        if more is None:
            # One round of a repeat that must occur still belongs to the run before it.
            if str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1 and (once := _sequence_strings(node[1][2])) and len(run) * len(once) <= ENUMERATED:
                run = {a + b for a, b in product(run, once)}
            run = flush(run)
        elif len(run) * len(more) > ENUMERATED:
            run = flush(run)
            run = more
        else:
            run = {a + b for a, b in product(run, more)}
    flush(run)
    return frozenset(clauses)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram number, doc_id, digest of the text) for each listed trigram in each text."""
    low = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.lower("text").alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(n)) for n, t in enumerate(trigrams))), lambda x: x.isNotNull())
    return low.select(F.explode(held).alias("trigram"), "doc_id", "digest")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, digest, rules) of documents that meet some rule's trigram query; bit n of ``rules`` stands for rule n."""
    asked = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    trigrams = sorted({t for query in asked.values() for clause in query for some in clause for t in some})
    number = {t: n for n, t in enumerate(trigrams)}
    words = max(1, -(-len(trigrams) // 63))
    masks = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") % 63).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"mask{w}")
        for w in range(words)
    ]
    grouped = postings(docs, trigrams).groupBy("doc_id", "digest").agg(*masks)

    def holds(some: frozenset[str]) -> Column:
        bits = [sum(1 << number[t] % 63 for t in some if number[t] // 63 == w) for w in range(words)]
        return reduce(and_, (F.col(f"mask{w}").bitwiseAND(F.lit(b)) == b for w, b in enumerate(bits) if b))

    met = F.lit(0)
    for n, query in asked.items():
        if query:
            all_clauses = reduce(and_, (reduce(or_, (holds(some) for some in sorted(clause, key=sorted))) for clause in sorted(query, key=lambda c: sorted(map(sorted, c)))))
            met = met + F.when(all_clauses, F.lit(1 << n)).otherwise(F.lit(0))
    return stored(grouped.select("doc_id", "digest", met.alias("rules")).where("rules > 0"), "candidates")


def _spans(rule: Rule, number: int, text: Column, matches: Column) -> Column:
    """(start, number, end) of the matches that are long enough, in characters: lengths of what lies between and of matches, added up."""
    pieces = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    parts = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"))), kept, lambda x, k: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(k).alias("kept")))
    empty = F.array().cast("array<struct<start: long, number: int, end: long, kept: int>>")
    summed = F.aggregate(
        parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(number).alias("number"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["kept"].alias("kept")))).alias("out"),
        ),
    )["out"]
    return F.transform(F.filter(summed, lambda s: s["kept"] >= rule.least), lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end")))


NO_SPANS = "array<struct<start: long, number: int, end: long>>"


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with an array of (start, rule number, end), in order of start, then rule.

    Offsets count characters; ends are exclusive. A null text has no spans. Null ids, equal ids and repeated rows are
    looked up by id and text together and all get their spans. An empty table gives an empty one.
    """
    found = candidates(docs.select("doc_id", "text"), rules)
    small = found.count() <= BROADCAST_ROWS
    right = found.toDF(f"{name}__id", f"{name}__digest", f"{name}__rules")
    key = docs.doc_id.eqNullSafe(F.col(f"{name}__id")) & (F.xxhash64("text") == F.col(f"{name}__digest"))
    rows = docs.join(F.broadcast(right) if small else right, key, "left")
    text, out = F.coalesce("text", F.lit("")), []
    matched = {}
    for n, rule in enumerate(rules):
        every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        if trigram_query(rule.pattern):
            every = F.when(F.col(f"{name}__rules").bitwiseAND(F.lit(1 << n)) > 0, every)
        matched[f"{name}__{n}"] = every
    rows = rows.withColumns(matched)
    for n, rule in enumerate(rules):
        matches = F.col(f"{name}__{n}")
        out.append(F.when(F.size(matches) > 0, _spans(rule, n, text, matches)).otherwise(F.array().cast(NO_SPANS)))
    return rows.withColumn(name, F.array_sort(F.concat(*out))).select(*(docs[c] for c in docs.columns), name)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span replaced by the kind of secret in angle brackets; overlapping spans by the first one's.

    Columns stay as they are; n_chars, where there is one, follows the new text.
    """
    name = "spans__"
    while name in docs.columns:
        name += "_"
    kinds = F.array(*(F.lit(f"<{r.kind}>") for r in rules))
    rows = with_spans(docs, rules, name)
    text = F.col("text")
    clean = F.aggregate(
        F.col(name), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.element_at(kinds, s["number"] + 1))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.lit(2**31 - 1))),
    )
    changed = F.size(name) > 0
    rows = rows.withColumn(f"{name}new", F.when(changed, clean).otherwise(text))
    columns = {c: F.col(f"`{c}`") for c in docs.columns}
    columns["text"] = F.col(f"{name}new")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length(f"{name}new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(v.alias(k) for k, v in columns.items()))
