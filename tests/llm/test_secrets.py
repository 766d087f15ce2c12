"""Secret scan: trigram queries, spans against Python's own expressions, redaction."""

import re

from equiloom.llm import secrets

KEY = "AKIA" + "Q7" * 9
HEX = "deadbeef" * 4
TEXTS = [
    None, "", "nothing", f"é {KEY} x", "password: hunter2 and token=abcdef", "secret=token: abcdefgh", "PassWord = 'p4ssw0rd/+_' tail", HEX + "g" + HEX[:23], "api_key:short apikey=longenough",
    "AKIA12", "token" + " " * 50 + "=abcdefg", f"\U0001F600 token='{HEX}'", "gh" + "p_" + "a1" * 20, "x " * 3000 + "passwd=abcdefg " + "y " * 3000, "-----BEGIN RSA PRIVATE KEY-----",
]
PATTERNS = (
    (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), (r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1), (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)


def brute(text):
    out = []
    for n, (pattern, group, least) in enumerate(PATTERNS):
        flags = re.IGNORECASE | re.ASCII if n == 0 else re.ASCII
        out += [(m.start(), n, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return sorted(out)


def frame(spark):
    rows = [(n if n % 4 else None, t, "x", n) for n, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == frozenset()
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == {frozenset({frozenset({"aki", "kia"})})}
    assert secrets.trigram_query("(abcd|xyz)?[0-9]+") == frozenset()
    assert secrets.trigram_query("abc.*(def|ghij)") == {frozenset({frozenset({"abc"})}), frozenset({frozenset({"def"}), frozenset({"ghi", "hij"})})}
    one, = secrets.trigram_query(secrets.BASE[0].pattern)
    assert frozenset({"tok", "oke", "ken"}) in one and len(one) == 6


def test_spans(spark):
    docs = frame(spark).select("doc_id", "text")
    found = secrets.with_spans(docs).collect()
    assert len(found) == len(TEXTS) + 1
    for row in found:
        assert [tuple(s) for s in row["spans"]] == brute(row["text"]), row["text"]
    assert secrets.with_spans(docs.limit(0)).count() == 0


def test_candidates_are_few(spark):
    rules = secrets.candidates(frame(spark), secrets.BASE).collect()
    assert 0 < len(rules) < len(TEXTS)


def test_shuffled_candidates_give_the_same(spark, monkeypatch):
    docs = frame(spark).select("doc_id", "text")
    rows = sorted(map(str, secrets.with_spans(docs).collect()))
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", -1)
    assert sorted(map(str, secrets.with_spans(docs).collect())) == rows


def test_redaction(spark):
    docs = frame(spark)
    rows = secrets.redacted(docs)
    assert rows.columns == docs.columns
    for row in rows.collect():
        original = TEXTS[row["n_chars"]] if row["n_chars"] < len(TEXTS) and TEXTS[row["n_chars"]] == row["text"] else None
        assert original is not None or row["text"] is None or (not brute(row["text"]) and "<" in row["text"] and row["n_chars"] == len(row["text"]))
    texts = {r["text"] for r in rows.collect()}
    assert "é <access> x" in texts and "\U0001F600 <assign>'" in texts
