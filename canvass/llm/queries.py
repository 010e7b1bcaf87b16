"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, archives, bpe, decontaminate, language, merkle, near_dedup, pivots, suffix_dedup, token_counts, topk, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The listed URLs of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without its repeated 100-byte strings."""
    done = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the listed URLs."""
    listed = spark.sql(f"SELECT * FROM VALUES {_RULES_SQL} AS listed(host, path, verdict)")
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all windows of the benchmark items."""
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probabilities along the chain, and whether it is toxic."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    models = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, models).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = _table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))
    model = language.fit(docs.where(fold != 1))
    return language.predict(docs.select("doc_id", (fold == 1).alias("held_out"), "text"), model).drop("text")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every vector whose id is divisible by 20."""
    vectors = topk.integers(_table(spark, sf_dir, "embeddings"), 64)
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC files and back."""
    found = archives.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths of all documents with its sums."""
    lengths = token_counts.encoded_lengths(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.histogram(lengths)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are at least 85 % alike."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), 85)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the tokens of every whole document, and of their decoded text."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the vectors of one label whose cosine is at least 0.93."""
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of two public tokenizers aligned in every whole document."""
    return alignment.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))


#: The columns that make a leaf of the manifest.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and whether each, tampered with
    where its doc_id's checksum says so, still proves to be under the root."""
    docs = _table(spark, sf_dir, "documents")
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    tampered = merkle.leaf([longer if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    done = merkle.manifest(docs, "lang", ["doc_id"], LEAF_COLUMNS, keep={"tampered": F.when(chosen, tampered)})
    folded = done.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_topk": op6_topk,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE = {
    "op2_url_filter": f"""
WITH rest AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), {_A_Z}) AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT p.r, rule_host || rule_path AS rule, u.verdict,
         row_number() OVER (PARTITION BY p.r ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS k
  FROM parts p JOIN rules u
    ON (p.host = u.rule_host OR ends_with(p.host, '.' || u.rule_host)) AND starts_with(p.path, u.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.r = p.r AND f.k = 1
""",
    "op7_warc": """
WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT r, page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM h WHERE n >= 100 GROUP BY digest)
SELECT h.page_id, h.n AS payload_bytes, h.digest AS payload_digest,
       CASE WHEN h.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN h.page_id <> f.first THEN f.first END AS refers_to
FROM h LEFT JOIN f ON h.digest = f.digest AND h.n >= 100
""",
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op11_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label,
         coalesce(label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
u AS (SELECT r, vec_id, label, x, sqrt(list_inner_product(x, x)) AS size FROM v WHERE usable),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b
    ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(u.vec_id) AS least FROM reach JOIN u ON u.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(least.least, v.vec_id), v.vec_id) AS component_id,
       v.vec_id = coalesce(least(least.least, v.vec_id), v.vec_id) AS kept
FROM v LEFT JOIN least ON least.r = v.r LEFT JOIN n ON n.r = v.r
""",
    "op13_merkle": """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS chars,
         coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') AS more,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
         list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM documents),
leaves AS (
  SELECT doc_id, lang, coalesce('1' || lang, '0') AS grp, sha256(head || chars || tail) AS leaf,
         CASE WHEN (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda crc, b:
           list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit:
             CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END))) % 7 = 0
           THEN sha256(head || more || tail) ELSE sha256(head || chars || tail) END AS shown FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
up AS (
  SELECT 0 AS level, grp, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, grp, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY level, grp, pos // 2, n),
subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
higher AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM higher WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT h AS root FROM higher WHERE n = 1),
ids AS (SELECT row_number() OVER () AS r, * FROM placed),
steps AS (
  SELECT ids.r, o.level AS level, 0 AS part, (ids.pos >> CAST(o.level AS BIGINT)) % 2 AS slot, s.h AS sibling
  FROM ids JOIN (SELECT DISTINCT grp, level FROM up WHERE n > 1) o ON o.grp = ids.grp
  LEFT JOIN up s ON s.grp = ids.grp AND s.level = o.level AND s.pos = xor(ids.pos >> CAST(o.level AS BIGINT), 1)
  UNION ALL
  SELECT ids.r, o.level, 1, (t.pos >> CAST(o.level AS BIGINT)) % 2, s.h
  FROM ids JOIN subroots t ON t.grp = ids.grp CROSS JOIN (SELECT DISTINCT level FROM higher WHERE n > 1) o
  LEFT JOIN higher s ON s.level = o.level AND s.pos = xor(t.pos >> CAST(o.level AS BIGINT), 1)),
paths AS (
  SELECT r, string_agg(coalesce(sibling, ''), '' ORDER BY part, level) AS siblings,
         list(CASE WHEN sibling IS NULL THEN '-' WHEN slot = 0 THEN '>' || sibling ELSE '<' || sibling END ORDER BY part, level) AS path FROM steps GROUP BY r),
folded AS (
  SELECT ids.doc_id, ids.leaf, t.subroot, root.root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(ids.shown, coalesce(path, [])), lambda h, s:
           sha256(CASE WHEN s[1] = '>' THEN h || s[2:] WHEN s[1] = '<' THEN s[2:] || h ELSE h END)) AS folded_root
  FROM ids JOIN subroots t ON t.grp = ids.grp CROSS JOIN root LEFT JOIN paths ON paths.r = ids.r)
SELECT *, folded_root = root AS verified FROM folded
""",
}
