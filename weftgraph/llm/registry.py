"""Queries opN_<name> over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_format
from .cluster import fold_ascii
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .jaccard import jaccard_classes
from .language import fit_languages, identify
from .line_dedup import line_dedup
from .packing import pack
from .pii import scan_pii
from .secrets import fit_secrets, scan_secrets
from .toxicity import fit_chain, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(fold_ascii(F.col("text")), 256)})


OP6_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def byte_bpe() -> str:
    """The vocabulary file that op2 is defined for."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), byte_bpe(), with_ids=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_chain(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, chain)
    return scored.select("doc_id", F.col("_is_toxic").alias("toxic"), F.col("_p_toxic").alias("p_toxic"), F.col("_p_low_quality").alias("p_low_quality"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, fit_secrets(docs))
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn IS NOT NULL AS numbered, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (
  SELECT conv_id, numbered, turn, count(*) AS n, string_agg(numbered || chr(1) || turn || chr(1) || role || chr(2) || text, chr(3) ORDER BY role, text) AS s
  FROM t GROUP BY conv_id, numbered, turn),
p AS (
  SELECT conv_id, sum(n) OVER w AS n, string_agg(s, chr(4)) OVER w AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY numbered DESC, turn DESC) = 1 AS is_last
  FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY numbered, turn)),
kept AS (
  SELECT min(conv_id) AS conv_id, min(n) AS n_turns FROM p
  WHERE is_last AND prefix NOT IN (SELECT prefix FROM p WHERE NOT is_last) GROUP BY prefix),
r AS (
  SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, row_number() OVER (PARTITION BY conv_id ORDER BY numbered, turn, role, substr(text, 1, 64), md5(text)) - 1 AS place,
         '<|' || role || '|>' || chr(10) || text || chr(10) AS line
  FROM t JOIN kept USING (conv_id))
SELECT conv_id, CAST(place // 256 AS BIGINT) AS part, n_turns, string_agg(line, '' ORDER BY place) AS rendered FROM r GROUP BY 1, 2, 3
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = line_dedup(docs, host=F.col("source"))
    return cleaned.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


OP10_SQL = """
WITH l AS (
  SELECT doc_id, rid, host, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, rid, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents))),
b AS (
  SELECT host, bare FROM l WHERE bare <> '' GROUP BY host, bare
  HAVING count(DISTINCT rid) >= 2 AND count(DISTINCT rid) >
    CAST(0.065 AS DOUBLE) * (SELECT count(*) FROM documents d WHERE coalesce(d.source, '') = l.host))
SELECT doc_id, count(*) AS n_lines, count(b.bare) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL), '') AS text
FROM l LEFT JOIN b ON l.host = b.host AND l.bare = b.bare GROUP BY doc_id, rid
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT rid, i, size, item FROM dw JOIN bw USING (size, win)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(True))
    filters = fit_languages(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') || CASE WHEN len(w) < 4 THEN ' ' ELSE '' END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def queries() -> dict:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_packing": op2_packing,
        "op3_toxicity": op3_toxicity,
        "op4_secrets": op4_secrets,
        "op5_chat_format": op5_chat_format,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_pii": op7_pii,
        "op8_language": op8_language,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op5_chat_format": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_line_dedup": OP10_SQL}
