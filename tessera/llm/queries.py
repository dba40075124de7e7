"""The registered queries of this subpackage and their SQL.

Each ``opN_<name>`` reads a whole table, applies its operator with production
parameters and returns the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversation_repair, exact_dedup, jaccard_join, language_id, lexical_search, mixing, packing, quality, suffix_dedup, token_counts, toxicity, url_filters
from .common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: (host, path, verdict) of the listed rules.
LISTED_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.Rule.host_path(*r) for r in LISTED_RULES]
    judged = url_filters.judge(read(spark, sf_dir, "pages"), [*rules, *url_filters.DEFAULT_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    index = toxicity.learn(docs, read(spark, sf_dir, "labels"), ~held)
    scored, name = toxicity.score(docs, index, carry=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), f"{name}.score", f"{name}.predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, name = quality.judge(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", f"{name}.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    counted, name = token_counts.count_tokens(read(spark, sf_dir, "documents"), path, carry=["doc_id"])
    return counted.select("doc_id", f"{name}.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    predicted, name = language_id.predict(docs, language_id.learn(docs, ~held), carry=["doc_id"])
    return predicted.select("doc_id", held.alias("held_out"), f"{name}.*")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    encoded, made = bpe_codec.encode(read(spark, sf_dir, "documents"), path, carry=["doc_id"])
    encoded = encoded.select("doc_id", f"{made}.ids")
    decoded, made = bpe_codec.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col(f"{made}.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with the contract's damage, and ``copies``: how often each row stands
    (0: it is gone, its conversation is not)."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(kind == 4, "user").otherwise(name("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    report, repaired = conversation_repair.repair(rows, copies="copies")
    hashed = conversation_repair.digest(repaired).select(F.col("conv").alias("conv_id"), "audit", F.col("sha256").alias("repaired_sha256"))
    counts = [c for c in report.columns if c != "conv"]
    return hashed.join(report, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", *counts, "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_toxicity, op3_mixing, op4_suffix_dedup, op5_quality_rules,
        op6_exact_dedup, op7_token_counts, op8_jaccard_join, op9_packing, op10_language_id,
        op11_bpe_codec, op12_lexical_search, op13_conversation_repair,
    )
}

OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url LIKE '%://%'
              THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%'
              THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max(h || p, length(h || p)) FROM rules
          WHERE ('.' || host) LIKE ('%.' || h) AND starts_with(path, p)) AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       COALESCE((SELECT max(v) FROM rules WHERE h || p = rule),
                CASE WHEN regexp_matches('.' || host || path, '/(ads|adserver|banner|casino|porn|xxx|viagra)/')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM by_source
), ranked AS (
  SELECT *, sum(source_size) OVER ()
            - COALESCE(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER ()
            - COALESCE(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_left
  FROM weighed
), level AS (
  SELECT arg_max(rest, weights_left) AS r, max(weights_left) AS w
  FROM ranked WHERE NOT rest * weight >= 3 * source_size * weights_left
), targets AS (
  SELECT source, source_size,
         CASE WHEN rest * weight >= 3 * source_size * weights_left THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(weight * r AS DOUBLE) / CAST(w AS DOUBLE) END AS target
  FROM ranked, level
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

OP6_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(COALESCE(text, '')) AS chars, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), grouped AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM normal
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM grouped
"""

OP12_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), doc AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id
), total AS (
  SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS n_terms FROM doc
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total
), scored AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN tf USING (term) JOIN doc ON doc.doc_id = tf.doc_id, total
  GROUP BY item_id, tf.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (  -- the table of CRC-32, of polynomial 0xEDB88320
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), base AS (
  SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                         lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '?' END AS initial
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous
  FROM placed
), inserted(q, inserts, cost, now, lines) AS (
  VALUES ('', '', 0, '', ''), ('', 'I', 2, 'u', 'user:'), ('', 'II', 4, 'a', 'user:' || chr(10) || 'assistant:'),
         ('s', '', 0, 's', ''), ('s', 'I', 2, 'u', chr(10) || 'user:'), ('s', 'II', 4, 'a', chr(10) || 'user:' || chr(10) || 'assistant:'),
         ('u', '', 0, 'u', ''), ('u', 'I', 2, 'a', chr(10) || 'assistant:'),
         ('a', '', 0, 'a', ''), ('a', 'I', 2, 'u', chr(10) || 'user:')
), moved(q, letter, initial, cost, now) AS (
  VALUES ('', 'K', 's', 0, 's'), ('', 'K', 'u', 0, 'u'), ('s', 'K', 'u', 0, 'u'), ('u', 'K', 'a', 0, 'a'), ('a', 'K', 'u', 0, 'u'),
         ('', 'R', NULL, 2, 'u'), ('s', 'R', NULL, 2, 'u'), ('u', 'R', NULL, 2, 'a'), ('a', 'R', NULL, 2, 'u'),
         ('', 'D', NULL, 3, ''), ('s', 'D', NULL, 3, 's'), ('u', 'D', NULL, 3, 'u'), ('a', 'D', NULL, 3, 'a')
), paths AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS q, 0 AS cost, '' AS audit, '' AS lines FROM judged
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT p.conv_id, j.i, m.now AS q, p.cost + n.cost + m.cost + CASE WHEN j.fault = 'truncated' AND m.letter <> 'D' THEN 1 ELSE 0 END AS cost,
           p.audit || n.inserts || m.letter AS audit,
           p.lines || n.lines || CASE m.letter WHEN 'D' THEN '' ELSE CASE WHEN m.q = '' THEN '' ELSE chr(10) END
             || CASE m.letter WHEN 'K' THEN j.role WHEN 'R' THEN CASE m.now WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || j.text END AS lines
    FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1
    JOIN inserted n ON n.q = p.q JOIN moved m ON m.q = n.now AND (m.initial IS NULL OR m.initial = j.initial)
    WHERE m.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')
    QUALIFY row_number() OVER (PARTITION BY p.conv_id, m.now ORDER BY p.cost + n.cost + m.cost + CASE WHEN j.fault = 'truncated' AND m.letter <> 'D' THEN 1 ELSE 0 END, p.audit || n.inserts || m.letter) = 1
  )
), ended AS (
  SELECT p.conv_id, p.cost + n.cost AS cost, p.audit || n.inserts AS audit, p.lines || n.lines AS lines
  FROM paths p JOIN (SELECT conv_id, max(i) AS i FROM judged GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i
  JOIN inserted n ON n.q = p.q AND n.now IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + n.cost, p.audit || n.inserts) = 1
), counted AS (
  SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT o.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, CAST(COALESCE(cost, 0) AS BIGINT) AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op3_mixing": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op12_lexical_search": OP12_SQL, "op13_conversation_repair": OP13_SQL}
