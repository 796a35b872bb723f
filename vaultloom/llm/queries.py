"""The queries of this folder's operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dedup, langid, licenses, lm, media, packing, secrets, token_matrix, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.packed(table(spark, sf_dir, "documents")))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op3_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.digest(token_matrix.written(token_matrix.matrix_rows(table(spark, sf_dir, "documents"))))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that match."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie at source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scanned(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


MOST_REPOSITORIES, MOST_OWNERS = 4, 2


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository is a source's documents of one language; the source owns it."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.found(docs, repository=F.concat_ws("/", "source", "lang"), owner="source", most_repositories=MOST_REPOSITORIES, most_owners=MOST_OWNERS))


URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path ends with the id of the document it shows; that document's label, if any, is the page's."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1)
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad")
    of = pages.select("page_id", F.when(shown != "", shown).cast("long").alias("doc_id")).where("doc_id is not null")
    return urls.judged(pages, of.join(labels.select("doc_id", bad), "doc_id"), URL_RULES)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", "text", (langid.remainder("doc_id", 5) == 0).alias("held_out"))
    return langid.identified(marked, langid.trained(docs), keep=("doc_id", "held_out"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85, k=64, overlap=36)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_column(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_pack": op1_pack,
    "op2_lm": op2_lm,
    "op3_token_matrix": op3_token_matrix,
    "op4_decontaminate": op4_decontaminate,
    "op5_licences": op5_licences,
    "op6_secrets": op6_secrets,
    "op9_urls": op9_urls,
    "op7_language": op7_language,
    "op8_minhash": op8_minhash,
    "op10_media": op10_media,
}

ORACLE: dict[str, str] = {
    "op5_licences": licenses.oracle("concat_ws('/', source, lang, doc_id::varchar)"),
    "op6_secrets": secrets.oracle(MOST_REPOSITORIES, MOST_OWNERS),
    "op8_minhash": dedup.oracle(3, 85),
    "op9_urls": urls.oracle(
        URL_RULES,
        r"select page_id, (toxic = 1 or quality = 0)::int as bad from (select page_id, try_cast(regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]{1,18})(?:[.][a-z]+)?/?(?:[?#].*)?$', 1) as bigint) as doc_id from pages) join labels using (doc_id)",
    ),
}
