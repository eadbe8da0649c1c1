"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import (
    chat,
    codes,
    decontaminate,
    exact_dedup,
    language_id,
    mixing,
    near_dedup,
    pieces,
    sharding,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)
from topicloom.llm.sql import codes_sql, mixing_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encoded.select("record.doc_id", "ids", "n_pieces", "round_trip")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0: fine, 1: of poor quality, 2: toxic."""
    documents = table(spark, sf_dir, "documents")
    grade = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("toxic") == 0, 0)
    graded = table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))
    settings = toxicity.Settings()
    model = toxicity.train(documents, graded, settings)
    return toxicity.grade_toxicity(documents, model, settings).withColumn("kept", ~F.col("toxic"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shuffle_into_shards(documents)
    text = F.coalesce("record.text", F.lit(""))
    return placed.select(
        "record.doc_id",
        sharding.record_size("record.text").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"))
    kept = ~F.col("contaminated")
    return judged.select("record.doc_id", "contaminated", kept.alias("kept"), "item_id", "share", "cosine")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.Settings(width=4))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = language_id.identify_languages(documents)
    return judged.select(
        "record.doc_id", "record.lang", "predicted", "posterior", "accepted", F.col("accepted").alias("kept")
    )


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mixing.plan_copies(mixing.prepare(documents, keep_rows=False))
    return planned.select("record.doc_id", "size", "source_size", "target", "taken", "expected", "copies")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_sentencepiece,
        op3_toxicity,
        op4_token_counts,
        op5_url_filters,
        op6_sharding,
        op7_decontamination,
        op8_exact_dedup,
        op9_minhash_near_dedup,
        op10_language_id,
        op11_source_mixing,
        op12_embedding_whitening,
        op13_vector_codes,
    )
}


def _rule_fits(rule: url_filters.HostRule) -> str:
    return (
        f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"
    )


def _glob_regex(glob: str) -> str:
    out = ""
    for k, part in enumerate(glob.split("**")):
        out += (".*" if k else "") + "[^/]*".join(
            "".join(c if c.isalnum() or c in "-/" else "[" + c + "]" for c in piece) for piece in part.split("*")
        )
    return out


def _url_sql() -> str:
    rules = sorted(url_filters.HOST_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {_rule_fits(r)} THEN '{r.name}'" for r in rules)
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules)
    glob = " ".join(
        f"WHEN regexp_full_match('.' || host || path, '{_glob_regex(g)}', 's') THEN '{g}'"
        for g in url_filters.BLOCK_GLOBS
    )
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS r
                 FROM pages),
    parts AS (SELECT page_id,
                     translate(regexp_extract(r, '^([^/?#]*)', 1),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    judged AS (SELECT *, CASE {rule} END AS rule, CASE {glob} END AS g FROM parts)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IS NOT NULL THEN CASE rule {verdict} END
                WHEN g IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
           CASE WHEN rule IS NULL THEN g END AS glob
    FROM judged"""


_CHAT_SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, CAST(floor(coalesce(turn, 0) / {chat.PART_TURNS}) AS BIGINT) AS block FROM turns),
whole AS (SELECT conv_id, count(*) AS n_turns,
                 list({{'role': role, 'text': text}}
                      ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
          FROM placed GROUP BY conv_id),
classes AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY said, n_turns),
kept AS (SELECT * FROM classes a WHERE NOT EXISTS (
           SELECT 1 FROM classes b WHERE b.n_turns > a.n_turns AND b.said[1:a.n_turns] = a.said)),
parts AS (SELECT conv_id, block, row_number() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS part
          FROM (SELECT DISTINCT conv_id, block FROM placed))
SELECT k.conv_id, CAST(p.part AS INTEGER) AS part, k.n_turns, k.n_copies,
       string_agg('{chat.OPEN}' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10) ||
                  replace(coalesce(t.text, ''), '<|', '< |') || '<|im_end|>' || chr(10), ''
                  ORDER BY t.turn NULLS FIRST, t.role NULLS FIRST, t.text NULLS FIRST) AS text
FROM kept k JOIN placed t USING (conv_id) JOIN parts p USING (conv_id, block)
GROUP BY k.conv_id, p.part, k.n_turns, k.n_copies"""

_LOWERED = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

SQL = {
    "op1_chat_formatting": _CHAT_SQL,
    "op5_url_filters": _url_sql(),
    "op8_exact_dedup": f"""
    WITH hashed AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM hashed WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_source_mixing": mixing_sql(),
    "op13_vector_codes": codes_sql(),
}
