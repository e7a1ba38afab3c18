"""The thin contract queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, html_main, lm, media, near_dedup, neighbours, packing, quality, secrets, substring


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return neighbours.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.crc_bucket("doc_id", 4) == 2
    scored = quality.score_documents(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(common.documents(spark, sf_dir), common.crc_bucket("doc_id", 5) == 1)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.documents(spark, sf_dir)).drop("row_key")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(common.documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(common.documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(common.documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup_substrings(common.documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", substring.removed_words().alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP4_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(text=f"translate(text, '{common.UPPER}', '{common.LOWER}')")}, []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {near_dedup.SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {near_dedup.SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {near_dedup.SHINGLE - 1}], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS held FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * held >= {near_dedup.PERCENT} * (a.n + b.n - held)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c(doc, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, c.seen FROM c JOIN e ON e.x = c.doc)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(c.seen) AS component_id, w.doc_id = min(c.seen) AS kept FROM w JOIN c ON c.doc = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""

_OP9_SQL = rf"""WITH w AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS ws FROM documents), g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {substring.WINDOW}),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(ws[i:i + {substring.WINDOW - 1}], ' ')) AS first FROM g), r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS k FROM m WHERE first < doc_id),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w), left_ AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.k) AS kept, count(*) AS n FROM k ANTI JOIN r ON r.doc_id = k.doc_id AND r.k = k.k GROUP BY k.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(left_.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ ON left_.doc_id = w.doc_id"""

_CONTRACT = (op1_neighbours, op2_quality, op3_lm, op4_near_dedup, op5_secrets, op6_bpe, op7_packing, op8_media, op9_substring_dedup, op10_html)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _CONTRACT} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op4_near_dedup": _OP4_SQL, "op5_secrets": secrets.oracle_sql(), "op9_substring_dedup": _OP9_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
