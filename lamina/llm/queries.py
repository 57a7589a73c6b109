"""The registered query of each corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op4_exact_dedup",
    """
    WITH t AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.exact import exact_copies

    return exact_copies(table(spark, sf_dir, "documents"))


def _url_rules():
    from lamina.llm.urls import Rule

    return (
        Rule("allow", "com", "/"),
        Rule("block", "example.com", "/en/"),
        Rule("allow", "www.example.com", "/en/"),
        Rule("block", "net", "/es/"),
        Rule("block", "net", "/fr/"),
    )


@query("op5_url_filter", oracles.URL_FILTER)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), _url_rules())


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


@query("op10_benchmark_decontamination", oracles.DECONTAMINATION)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


@query("op3_jaccard_join", oracles.JACCARD_JOIN)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.jaccard import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).drop("set_id")


@query("op7_substring_dedup", oracles.SUBSTRING_DEDUP)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.substrings import repeated_words

    return repeated_words(table(spark, sf_dir, "documents")).drop("kept_text")


@query("op8_suffix_dedup", oracles.SUFFIX_DEDUP)
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.suffixes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).drop("found")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query(
    "op13_source_mix",
    """
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
               (CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE))
                   / 4503599627370496 AS u
        FROM documents
    ),
    s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
        FROM d GROUP BY source
    ),
    o AS (
        SELECT source, s, w, coalesce(sum(3 * s) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
               sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, sum(s) OVER () AS total
        FROM s WINDOW q AS (ORDER BY s / w, source NULLS LAST)
    ),
    l AS (SELECT total - capped AS rest, ws FROM o WHERE NOT 3 * s * ws < w * (total - capped) ORDER BY s / w, source NULLS LAST LIMIT 1),
    t AS (
        SELECT source, s, CASE WHEN 3 * s * ws < w * (total - capped) THEN CAST(3 * s AS DOUBLE)
                               ELSE w * CAST((SELECT rest FROM l) AS DOUBLE) / CAST((SELECT ws FROM l) AS DOUBLE) END AS target
        FROM o
    ),
    r AS (
        SELECT doc_id, size, u, d.source, s AS source_size, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS copies,
               CASE WHEN s > 0 THEN target / s - floor(target / s) ELSE 0 END AS chance
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ),
    p AS (
        SELECT *, sum(size) OVER (PARTITION BY source, chance > 0 ORDER BY (u / (1 - u)) / (chance / nullif(1 - chance, 0)), doc_id NULLS LAST, size) AS after
        FROM r
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * (copies + CASE WHEN chance > 0 AND 2 * after - size < 2 * (target - copies * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM p
    """,
)
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs", oracles.PERIODIC_RUNS)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.periodic import periodic_runs, run_digests, with_planted_periods

    return run_digests(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))


@query("op12_spelling_variants", oracles.SPELLING_VARIANTS)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamina.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), drop_one_in=199)
