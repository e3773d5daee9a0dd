"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .exact_dedup import exact_duplicates
from .lattice_sampling import segmentation_digests
from .license_scan import scan_licenses
from .line_dedup import without_repeated_lines
from .minhash import near_duplicates
from .packing import pack
from .pii import personal_data
from .simhash import op10
from .toxicity import score, train
from .url_filter import judge_urls


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digests(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), shorter=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_gumbel_segmentation": op7_gumbel_segmentation,
    "op8_pii": op8_pii,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        with d as (
            select doc_id, coalesce(length(text), 0) as n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
            from documents),
        g as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
                     count(*) over (partition by text_sha256) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
    "op6_minhash_near_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents),
        s as (
            select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
                                when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles
            from w),
        n as (select doc_id, cast(len(shingles) as bigint) as n from s),
        e as (select doc_id, unnest(shingles) as shingle from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
        link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
        walk(doc_id, l) as (select doc_id, doc_id from n union select link.b, walk.l from walk join link on link.a = walk.doc_id where walk.l < link.b),
        least as (select doc_id, min(l) as component_id from walk group by doc_id)
        select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from n join least using (doc_id)""",
}
