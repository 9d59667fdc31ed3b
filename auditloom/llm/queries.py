"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary is installed; operators take the place as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).drop("raw")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_paragraphs

    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Both turns of the conversation -1.
MARKS = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_packs, read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    path = vocabulary("byte_bpe_50k.tiktoken")
    read = read_back(chat_packs(rows.unionByName(own), path), path)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("raw", "group")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the table, in two increments: an earlier state that lacked half of the paths, then all of them.

    The second scans no blob that the ledger of the first holds, and joins the
    findings of both back to all paths.
    """
    from .secret_scan import increment, secret_scan

    docs = table(spark, sf_dir, "documents")
    earlier = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(True)))
    found, ledger = increment(earlier)
    paths, _, _ = secret_scan(docs, ledger=ledger, findings=found)

    def found(rule: str):
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")

    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    named = paths.withColumn("spans_text", spans)
    return named.select("doc_id", *[found(rule) for rule in ("assign", "access", "hex")], F.sha2("spans_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_substring_dedup, op3_token_counts, op4_packing, op5_language_id, op6_decontamination, op7_chat_format, op8_html_extract, op9_minhash_dedup, op10_secret_scan)
}

ORACLE = {
    "op1_exact_dedup": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
        u AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM u""",
    "op10_secret_scan": """
        WITH rules AS (SELECT * FROM (VALUES
            (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 12),
            (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
            (2, 'hex', '[0-9a-f]+', 0, 16)) r(rank, kind, pattern, grp, least)),
        t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
        m AS (SELECT row_id, rank, kind, least,
                string_split_regex(text, pattern) AS gaps,
                regexp_extract_all(text, pattern, 0) AS hits,
                CASE WHEN grp = 1 THEN regexp_extract_all(text, pattern, 1) ELSE regexp_extract_all(text, pattern, 0) END AS held
              FROM t, rules),
        e AS (SELECT row_id, rank, kind, least, generate_subscripts(hits, 1) AS i, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(held) AS val FROM m WHERE len(hits) > 0),
        p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row_id, rank ORDER BY i) AS stop FROM e),
        s AS (SELECT row_id, rank, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE length(val) >= least),
        g AS (SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY row_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g USING (row_id)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
