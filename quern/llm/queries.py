"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, langid, licenses, near_dedup, packing, secrets, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_packing, op3_exact_dedup, op4_language_id, op5_warc, op6_secret_scan, op7_near_dedup, op8_bpe, op9_substring_dedup, op10_ann, pipeline)}


def _license_sql() -> str:
    rows = []
    for name, text in licenses.TEMPLATES:
        grams = licenses.bigrams(licenses._words(text))
        rows.append(f"('{name}', [{', '.join(repr(g) for g in grams)}], {len(grams)})")
    between = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"
    return f"""
        with t(id, grams, m) as (values {', '.join(rows)}),
        u as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
        lines as (select k, unnest(string_split(text, chr(10)) || case when contains(text, chr(10)) then [text] else [] end) as l from u),
        folded as (select k, regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{between}', ' ', 'g') as l from lines),
        w as (select row_number() over () as line, k, string_split(trim(l), ' ') as w from folded),
        g as (select line, k, len(w) - 1 as n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as grams from w where len(w) between 2 and 80),
        s as (select line, k, id, 2.0::double * len(list_intersect(g.grams, t.grams)) / (n + m) as score from g join t on true),
        best as (select k, line, max(score) as score, arg_min(id, (-score, id)) as id from s group by k, line having max(score) >= {licenses.THRESHOLD}),
        d as (select k, count(*) as n_hits, array_to_string(list_sort(list_distinct(list(id))), ',') as licenses, max(score) as best from best group by k)
        select doc_id, coalesce(n_hits, 0) as n_hits, coalesce(licenses, '') as licenses, best from u left join d using (k)
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": _license_sql(),
        "op3_exact_dedup": """
            with d as (
              select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
              from documents
            )
            select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
                   doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
            from d
        """,
    }
