"""URL verdicts: listed rules first, then association rules that Spark's FP-growth mines from labelled URLs.

The labels are the verdicts of the listed rules. A URL's tokens are its host's labels, path segments and query keys; frequent combinations
that imply a verdict become rules, pruned by support, confidence, and by more general rules that say as much. Each rule is filed in an inverted
index under its rarest token; a URL meets only the rules filed under its own tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from equiloom.llm.common import stored

MARK = "="
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Listed:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


#: Fixed values.
LISTED = (
    Listed("allow", "org/"),
    Listed("block", "example.org/es/"),
    Listed("block", "example.org/en/1"),
    Listed("allow", "com/fr/"),
    Listed("block", "com/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.position(F.lit("://"), url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def listed_rule(rules: tuple[Listed, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, or nulls. A rule fits its host and all below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Different tokens: h:label of the host, p:segment of the path, q:key of the query."""
    def marked(mark: str, items: Column) -> Column:
        return F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(marked("h:", F.split(host, r"\.")), marked("p:", F.split(path, "/")), marked("q:", keys)))


def useful_items(labelled: DataFrame, total: int, support: float) -> dict[str, tuple[str, int]]:
    """{token: (class, URLs)} of the tokens that can be in a rule; tokens of exactly the same URLs are one class, named after its first.

    Tokens below the support can be in no rule, and tokens that every URL has tell nothing. The URLs of a token are told by
    their number and two sums of their rows' hashes, taken by one aggregate. At most tokens a URL / support tokens are left.
    """
    rows = labelled.select(F.xxhash64(F.monotonically_increasing_id()).alias("row"), "tokens")  # numbered before they are taken apart
    each = rows.select("row", F.explode("tokens").alias("item")).groupBy("item").agg(
        F.count("*").alias("n"), F.bit_xor("row").alias("x"), F.sum(F.col("row").cast("decimal(38,0)")).alias("s"))
    found = each.where((F.col("n") >= total * support) & (F.col("n") < total)).collect()
    first: dict[tuple, str] = {}
    for r in sorted(found, key=lambda r: r["item"]):
        first.setdefault((r["n"], r["x"], r["s"]), r["item"])
    return {r["item"]: (first[r["n"], r["x"], r["s"]], r["n"]) for r in found}


def mined(labelled: DataFrame, support: float = 0.01, confidence: float = 0.8) -> tuple[DataFrame, dict[str, str]]:
    """Rules (key, items, verdict, confidence, support) from ``labelled`` (tokens, verdict), and the class of each token; key is the rarest item.

    Items are classes of tokens that stand in exactly the same URLs, as a deep path's do: any of them says the same, so that a rule stands for all its
    choices of one token a class, and larger choices, which smaller ones make needless, are never made.
    """
    total = labelled.count()
    empty = labelled.sparkSession.createDataFrame([], "key string, items array<string>, verdict string, confidence double, support double")
    known = useful_items(labelled, total, support) if total else {}
    if not known:
        return empty, {}
    classes = {item: name for item, (name, _) in known.items()}
    counts = F.create_map(*(F.lit(x) for name, n in {name: n for name, n in known.values()}.items() for x in (name, n)))
    baskets = labelled.select(F.concat(of_classes("tokens", classes), F.array(F.concat(F.lit(MARK), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    verdict = F.element_at("consequent", 1)
    rules = model.associationRules.where(F.startswith(verdict, F.lit(MARK))).where(~F.exists("antecedent", lambda x: F.startswith(x, F.lit(MARK))))
    rarest = F.array_min(F.transform("antecedent", lambda x: F.struct(F.element_at(counts, x).alias("n"), x.alias("item"))))["item"]
    rules = stored(rules.select(rarest.alias("key"), F.array_sort("antecedent").alias("items"), F.substring(verdict, 2, 1000).alias("verdict"), "confidence", "support"), "rules")
    # A rule goes if a part of its items is a rule with the same verdict and no less confidence.
    wide = rules.select(F.monotonically_increasing_id().alias("id"), "*")
    general = rules.select(F.col("items").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"), F.col("key").alias("under"))
    beaten = (
        wide.select("id", "items", "verdict", "confidence", F.explode("items").alias("under")).join(general, "under")
        .where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("same") == F.col("verdict")) & (F.col("sure") >= F.col("confidence")))
    )
    wide = stored(wide.join(beaten.select("id").distinct(), "id", "left_anti"), "kept")
    return wide.select("key", "items", "verdict", "confidence", "support"), classes


def of_classes(tokens: str, classes: dict[str, str]) -> Column:
    """The different classes of an array of tokens; tokens without one go."""
    if not classes:
        return F.array().cast("array<string>")
    names = F.create_map(*(F.lit(x) for pair in sorted(classes.items()) for x in pair))
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.try_element_at(names, t)), lambda c: c.isNotNull()))


def judged(urls: DataFrame, rules: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(url, method_verdict, items, confidence) of the surest rule for each url of ``urls`` (url, tokens) that some rule fits.

    Of equally sure rules the one with more support counts, then block, then the items in order. A rule's items are told as classes.
    """
    small = rules.count() <= BROADCAST_RULES
    known = urls.select("url", of_classes("tokens", classes).alias("has"))
    met = known.select("url", "has", F.explode("has").alias("key")).join(F.broadcast(rules) if small else rules, "key")
    met = met.where(F.size(F.array_except("items", "has")) == 0)
    best = F.max(F.struct("confidence", "support", "verdict", "items"))
    return met.groupBy("url").agg(best.alias("best")).select("url", F.col("best.verdict").alias("method_verdict"), F.col("best.items").alias("items"), F.col("best.confidence").alias("confidence"))


def verdicts(pages: DataFrame, rules: tuple[Listed, ...] = LISTED, default: str = "allow", support: float = 0.01, confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, method_items, method_confidence) for every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path. The verdict is the longest listed rule's that fits, else the
    surest mined rule's, else ``default``. Repeated rows are judged alike; mining counts each row. An empty table gives an empty one.
    """
    url = F.col("url")
    rows = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"))
    rule, verdict = listed_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "listed": verdict})
    with_tokens = rows.select("url", "listed", tokens(url, F.col("host"), F.col("path")).alias("tokens"))
    found, classes = mined(with_tokens.where("listed is not null").select("tokens", F.col("listed").alias("verdict")), support, confidence)
    open_urls = with_tokens.where("listed is null and url is not null").groupBy("url").agg(F.first("tokens").alias("tokens"))
    by_method = judged(open_urls, found, classes)
    return rows.join(by_method, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "method_verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.col("items")).alias("method_items"), F.when(F.col("listed").isNull(), F.col("confidence")).alias("method_confidence"),
    )
