"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from equiloom.llm import centroids, chat, decontaminate, packing, ppm, prefixtrie, quality, secrets, simhash, tokenfile, toxicity, urlrules, voronoi
from equiloom.llm.common import fold, table

#: Where the tokenizer's file is; None asks the installed package.
TOKENIZER: str | None = None


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), limit=2)
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["number"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["number"] < len(secrets.BASE))
    return found.select(
        "doc_id", *(number(n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE)),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 1)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_parts().alias("parts"))))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=10)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    if TOKENIZER:
        return tokenfile.token_digests(table(spark, sf_dir, "documents"), TOKENIZER)
    import public_tokenizers

    return tokenfile.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id")) == 0
    net = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), ~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(net, spark)("text").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), name="judgement")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    removed = F.size("judgement.removed").cast("long").alias("n_removed_lines")
    return found.select("doc_id", *(F.col(f"judgement.{n}").alias(n) for n in names), removed, F.sha2("judgement.cleaned", 256).alias("cleaned_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(prefixtrie.ordered_turns(table(spark, sf_dir, "conversations")), block=100, most=6))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_topk_search, op3_secrets, op4_url_filter, op5_packing, op6_lm_score, op7_chat_format, op8_decontamination, op9_token_files, op10_toxicity, op11_quality_rules, op12_centroids, op13_prefix_trie, pipeline)
}

ORACLES: dict[str, str] = {}

ORACLES["op2_topk_search"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

#: kind, expression, group that must be long enough, its least length
_SQL_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
_SQL_FOUND = "\nUNION ALL\n".join(
    f"""SELECT row, {n} AS number, '{kind}' AS kind, gap_end + before AS start, gap_end + before + size AS stop
FROM (
  SELECT row, kept, length(matched) AS size,
    sum(length(gap)) OVER (PARTITION BY row ORDER BY i) AS gap_end,
    coalesce(sum(length(matched)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (
    SELECT row, unnest(matches) AS matched, unnest(groups) AS kept, unnest(gaps[:len(matches)]) AS gap, generate_subscripts(matches, 1) AS i
    FROM (SELECT row, regexp_extract_all(body, '{pattern}', 0) AS matches, regexp_extract_all(body, '{pattern}', {group}) AS groups, string_split_regex(body, '{pattern}') AS gaps FROM texts)
  )
) WHERE length(kept) >= {least}"""
    for n, (kind, pattern, group, least) in enumerate(_SQL_RULES)
)
ORACLES["op3_secrets"] = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
found AS ({_SQL_FOUND}),
summed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, number) FILTER (number < 3) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, number) AS spans
  FROM found GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN summed USING (row)"""

ORACLES["op7_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ':' || chr(10)
    || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""

_SQL_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLES["op8_decontamination"] = f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_SQL_WORDS}, []) AS words FROM documents),
items AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[i:i + 9], ' ') AS phrase
  FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT row, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT row, words, size, unnest(range(1, greatest(1, len(words) - size + 2))) AS i FROM texts, sizes)
),
hits AS (SELECT row, i, size, item_id FROM places JOIN windows USING (size, phrase)),
hit_words AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS word FROM hits) GROUP BY row),
hit_items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM hits) GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)"""

_SQL_MENU, _SQL_NOTICES = "|".join(quality.MENU), "|".join(quality.NOTICES)


def _sql_list(signs) -> str:
    return "(" + ", ".join("'" + s.replace("'", "''") + "'" for s in signs) + ")"


def _sql_count(text: str, signs: str) -> str:
    return f"(length({text}) - length(translate({text}, '{signs}', '')))"


_SQL_SPACE = r"[\x20\x09-\x0D]"
_SQL_REPEATS = r"""
  SELECT row, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT row, unnest(range(i, i + 8)) AS word FROM (
      SELECT row, i, count(*) OVER (PARTITION BY row, phrase) AS n FROM (
        SELECT row, i, words[i:i + 7] AS phrase FROM (SELECT row, words, unnest(range(1, greatest(1, len(words) - 6))) AS i FROM texts)
      )
    ) WHERE n > 1
  ) GROUP BY row"""
ORACLES["op11_quality_rules"] = rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
repeats AS ({_SQL_REPEATS}),
lines AS (
  SELECT row, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, {_sql_count("line", "|<>»«›‹•·→")} AS bars, {_sql_count("line", "#*$%&|<>!?.~^=_")} AS marks,
    regexp_replace(line, '[\x20\x09-\x0D"''”’»)\]}}”]+$', '') AS bare
  FROM (SELECT row, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM texts)
),
ruled AS (
  SELECT *, CASE
    WHEN n = 0 THEN NULL
    WHEN n <= 30 AND regexp_matches(line, '({_SQL_NOTICES})', 'i') THEN 'boilerplate'
    WHEN bars >= 3 AND n <= 4 * (bars + 1) + bars OR n <= 30 AND regexp_matches(line, '^({_SQL_SPACE}*({_SQL_MENU})[,;/\x20\x09-\x0D]*)+$', 'i') THEN 'navigation'
    WHEN n >= 4 AND marks > n THEN 'marks'
    WHEN right(bare, 1) NOT IN {_sql_list(quality.ENDS)} THEN 'punctuation'
  END AS rule FROM lines
),
judged AS (
  SELECT row, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, count(rule) AS n_removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (rule IS NULL), '') AS cleaned
  FROM ruled GROUP BY row
),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, {_sql_count("body", "#*$%&|<>")}::BIGINT AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_removed_lines, cleaned
  FROM texts JOIN judged USING (row) LEFT JOIN repeats USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * length(regexp_replace(cleaned, '{_SQL_SPACE}', '', 'g')) >= word_chars AS kept,
  n_removed_lines, sha256(cleaned) AS cleaned_sha256
FROM counted"""

_SQL_NEAR = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _sql_round(n: int) -> str:
    return f"""assigned{n} AS MATERIALIZED (
  SELECT row, vec_id, v, arg_min(number, struct_pack(d := {_SQL_NEAR}, number := number)) AS cluster, min({_SQL_NEAR}) AS distance
  FROM vectors, centroids{n} GROUP BY row, vec_id, v
),
means{n} AS (
  SELECT cluster AS number, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(x)::BIGINT AS total, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM assigned{n}) GROUP BY cluster, i
  ) GROUP BY cluster
),
centroids{n + 1} AS MATERIALIZED (SELECT number, coalesce(means{n}.c, centroids{n}.c) AS c FROM centroids{n} LEFT JOIN means{n} USING (number))"""


ORACLES["op12_centroids"] = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS number, v AS c FROM vectors QUALIFY number < 8
),
{",".join(chr(10) + _sql_round(n) for n in range(10))},
chosen AS (
  SELECT row, vec_id, arg_min(number, struct_pack(d := {_SQL_NEAR}, number := number)) AS cluster, min({_SQL_NEAR}) AS distance FROM vectors, centroids10 GROUP BY row, vec_id
)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM chosen JOIN centroids10 ON cluster = number"""

ORACLES["op13_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 256), left(text, 256), digest) AS place FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::UBIGINT)), lambda a, i: xor(a >> 1, 3988292384::UBIGINT * (a & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
),
joined AS (
  SELECT c.conv_id, 0 AS part, p.place, p.digest, length(p.text) AS chars FROM convs c JOIN placed p ON p.conv_id = c.base AND p.place <= c.h
  UNION ALL SELECT c.conv_id, 1, p.place, p.digest, length(p.text) FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.place > c.h
),
rebuilt AS (SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM joined),
prefixes AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS chars FROM convs
  UNION ALL SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth), chars FROM rebuilt
),
terminal AS (SELECT conv_id, arg_max(prefix, depth) AS last FROM prefixes GROUP BY conv_id),
basic AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last = prefix) AS ends, CASE WHEN depth > 0 THEN left(prefix, 64 * (depth - 1)) END AS upper
  FROM prefixes JOIN terminal USING (conv_id) GROUP BY depth, prefix
),
children AS (SELECT upper AS prefix, count(*) AS n_children FROM basic WHERE depth > 0 GROUP BY upper),
pairs AS (SELECT DISTINCT a.prefix, b.prefix AS below FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT pairs.prefix, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM pairs JOIN basic ON basic.prefix = below LEFT JOIN children ON children.prefix = below GROUP BY pairs.prefix
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM basic n JOIN sums USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN basic p ON p.prefix = n.upper"""

_SQL_STEPS = 15
_SQL_LONGEST = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1"
_SQL_DP = ",\n".join(
    f"""dp{k} AS MATERIALIZED (
  SELECT b.j, min(p.best + b.top * (b.upto - a.upto) - (b.total - a.total)) AS best, arg_min(a.j, struct_pack(c := p.best + b.top * (b.upto - a.upto) - (b.total - a.total), i := a.j)) AS cut
  FROM bins b JOIN starts a ON a.j < b.j AND a.j >= {k} JOIN dp{k - 1} p ON p.j = a.j GROUP BY b.j
)"""
    for k in range(1, _SQL_STEPS + 1)
)
ORACLES["op5_packing"] = f"""
WITH RECURSIVE texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, ({_SQL_LONGEST})::BIGINT AS n_tokens FROM documents),
widths AS (SELECT *, pow(2, greatest(floor(log2(n_tokens)) - 10, 0))::BIGINT AS width FROM texts),
grouped AS (SELECT max(n_tokens) AS top, count(*) AS n, sum(n_tokens)::BIGINT AS own FROM widths GROUP BY ceil(n_tokens / width) * width),
bins AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY top) AS j, top, (sum(n) OVER (ORDER BY top))::BIGINT AS upto, (sum(own) OVER (ORDER BY top))::BIGINT AS total FROM grouped
),
starts AS (SELECT 0 AS j, 0 AS upto, 0 AS total UNION ALL SELECT j, upto, total FROM bins),
dp0 AS MATERIALIZED (SELECT j, top * upto - total AS best, 0 AS cut FROM bins),
{_SQL_DP},
tables AS ({" UNION ALL ".join(f"SELECT {k} AS k, * FROM dp{k}" for k in range(_SQL_STEPS + 1))}),
ends AS (SELECT arg_min(k, struct_pack(b := best, k := k)) AS k, max(j) AS j FROM tables WHERE j = (SELECT max(j) FROM bins)),
path AS (SELECT k, j FROM ends UNION ALL SELECT path.k - 1, t.cut FROM path JOIN tables t ON t.k = path.k AND t.j = path.j WHERE path.k > 0),
buckets AS (SELECT path.k AS bucket, top AS boundary FROM path JOIN bins USING (j)),
placed AS (
  SELECT row, doc_id, n_tokens, min(bucket) AS bucket, min(boundary) AS boundary FROM texts JOIN buckets ON n_tokens <= boundary GROUP BY row, doc_id, n_tokens
),
ordered AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS place, greatest(65536 // boundary, 1) AS capacity FROM placed)
SELECT doc_id, n_tokens, bucket, boundary, place // capacity AS batch, place % capacity AS slot, boundary - n_tokens AS padding FROM ordered"""

_SQL_REST = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_SQL_LISTED = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_SQL_FITS = "\n".join(
    f"    WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r} {v}'"
    for v, r in sorted(_SQL_LISTED, key=lambda x: -len(x[1]))
)
ORACLES["op4_url_filter"] = f"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS row, page_id, url, {_SQL_REST} AS rest FROM pages
),
split AS (
  SELECT row, page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^?#]*\\?([^#]*)', 1) AS query FROM parts
),
ruled AS MATERIALIZED (
  SELECT *, CASE
{_SQL_FITS}
  END AS fit FROM split
),
listed AS (SELECT row, page_id, url, host, path, nullif(split_part(coalesce(fit, ''), ' ', 1), '') AS rule, nullif(split_part(coalesce(fit, ''), ' ', 2), '') AS listed, query FROM ruled),
tokens AS MATERIALIZED (
  SELECT DISTINCT row, url, listed, token FROM (
    SELECT row, url, listed, 'h:' || unnest(string_split(host, '.')) AS token FROM listed UNION ALL
    SELECT row, url, listed, 'p:' || unnest(string_split(path, '/')) FROM listed UNION ALL
    SELECT row, url, listed, 'q:' || split_part(unnest(string_split(query, '&')), '=', 1) FROM listed
  ) WHERE length(token) > 2
),
total AS (SELECT count(*) AS n FROM listed WHERE listed IS NOT NULL),
useful AS (
  SELECT token, count(*) AS n, string_agg(row::VARCHAR, ',' ORDER BY row) AS rows FROM tokens WHERE listed IS NOT NULL GROUP BY token
  HAVING count(*) >= (SELECT n * 0.01::DOUBLE FROM total) AND count(*) < (SELECT n FROM total)
),
classes AS MATERIALIZED (SELECT token, min(token) OVER (PARTITION BY rows) AS class FROM useful),
sets AS MATERIALIZED (
  SELECT row, any_value(url) AS url, any_value(listed) AS listed, list_sort(list(DISTINCT class)) AS has FROM tokens JOIN classes USING (token) GROUP BY row
),
choices(row, step, chosen) AS (
  SELECT row, 0, []::VARCHAR[] FROM sets
  UNION ALL SELECT c.row, c.step + 1, unnest([c.chosen, list_append(c.chosen, s.has[c.step + 1])]) FROM choices c JOIN sets s ON c.row = s.row WHERE c.step < len(s.has)
),
subsets AS MATERIALIZED (SELECT c.row, s.url, s.listed, c.chosen AS items FROM choices c JOIN sets s ON c.row = s.row WHERE c.step = len(s.has) AND len(c.chosen) > 0),
having_items AS (SELECT items, count(*) AS n FROM subsets WHERE listed IS NOT NULL GROUP BY items),
rules AS MATERIALIZED (
  SELECT items, listed AS verdict, count(*) / any_value(h.n) AS confidence, count(*) / any_value(t.n) AS support
  FROM subsets JOIN having_items h USING (items), total t WHERE listed IS NOT NULL GROUP BY items, listed
  HAVING count(*) >= ceil(any_value(t.n) * 0.01::DOUBLE) AND count(*) / any_value(h.n) >= 0.8
),
needed AS (
  SELECT * FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules g WHERE len(g.items) < len(r.items) AND g.verdict = r.verdict AND g.confidence >= r.confidence AND list_has_all(r.items, g.items))
),
best AS (
  SELECT row, max(struct_pack(confidence := confidence, support := support, verdict := verdict, items := items)) AS b
  FROM subsets JOIN needed USING (items) WHERE listed IS NULL GROUP BY row
)
SELECT page_id, host, path, rule, coalesce(listed, b.verdict, 'allow') AS verdict, b.items AS method_items, b.confidence AS method_confidence
FROM listed LEFT JOIN best USING (row)"""
