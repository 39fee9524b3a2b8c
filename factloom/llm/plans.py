"""Queries of the text problems and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.durable import cut
from factloom.llm import capping, formatting_copies, language, leakage, names, packing, residue
from factloom.session import table

SHARE = 0.01


def _source_key() -> F.Column:
    key = F.lower(F.regexp_replace("source", r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def _groups(spark: SparkSession, root: str) -> DataFrame:
    return names.same_entity(table(spark, root, "entities").select("entity_id", "name", "type"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of rows that name the same entity."""
    groups = cut(_groups(spark, root), "groups")
    other = groups.select(F.col("entity_id").alias("entity_id_b"), "group_key")
    pairs = groups.withColumnRenamed("entity_id", "entity_id_a").join(other, "group_key")
    return pairs.where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b").distinct()


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each row of `entities` with the smallest entity_id of its group and the group's size."""
    groups = cut(_groups(spark, root), "groups")
    sizes = groups.groupBy("group_key").agg(F.min("entity_id").alias("group_id"), F.count("*").alias("variants"))
    return groups.join(sizes, "group_key").select("entity_id", "group_id", "variants")


def _articles(spark: SparkSession, root: str) -> tuple[DataFrame, language.Models]:
    articles = table(spark, root, "articles").select("doc_id", "title", "summary", "language")
    return articles, language.train_labelled(language.sample_labelled(articles, "language", ["title", "summary"], "doc_id"))


def _sentences(spark: SparkSession, root: str) -> DataFrame:
    return language.detect(*_articles(spark, root), "doc_id", ["title", "summary"], "language")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Languages of the articles whose label is missing or wrong or that mix languages."""
    return language.label_errors(*_articles(spark, root), "doc_id", ["title", "summary"], "language").distinct()


def p3_languages(spark: SparkSession, root: str) -> DataFrame:
    """Each article's languages with the share of its sentences and the mean confidence."""
    judged = _sentences(spark, root).where("lang is not null")
    return judged.groupBy("doc_id", "lang").agg(F.countDistinct("seq").alias("sentences"), F.round(F.avg("confidence"), 4).alias("confidence"), F.max("mixed").alias("mixed"))


def p3_segments(spark: SparkSession, root: str) -> DataFrame:
    """Language and confidence of each sentence of mixed articles."""
    return _sentences(spark, root).where("mixed").select("doc_id", "seq", "sentence", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Articles that go when each source is held to one percent of all."""
    articles = table(spark, root, "articles").select("doc_id", "source", "credibility")
    return capping.over_cap(articles, _source_key(), "doc_id", F.col("credibility"), share=SHARE).select("doc_id").distinct()


def p5_kept(spark: SparkSession, root: str) -> DataFrame:
    """Articles that remain, with the source they count for."""
    articles = table(spark, root, "articles").select("doc_id", "source", "credibility")
    gone = capping.over_cap(articles, _source_key(), "doc_id", F.col("credibility"), share=SHARE)
    return articles.select("doc_id", _source_key().alias("source_key")).distinct().join(gone.select("doc_id"), "doc_id", "left_anti")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Each group of equal records: the one that stays with each that goes."""
    items = table(spark, root, "evidence_items").select("item_id", "source", "title")
    return formatting_copies.copy_groups(items).select(F.col("keep").alias("keep_item_id"), F.col("copy").alias("copy_item_id"))


def p6_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """One record per group with the number of its copies, itself counted."""
    return p6_found(spark, root).groupBy("keep_item_id").agg((F.count("*") + 1).alias("copies"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """A container for each document, or for each piece of one that is longer than a container."""
    return packing.pack(table(spark, root, "documents"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers, tokens and the share of room in use."""
    held = p7_containers(spark, root).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return held.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count("*") * packing.CAPACITY), 4).alias("fill"))


def p7_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Documents that have a container, containers that hold too much, documents split without need, pieces lost."""
    packed = cut(p7_containers(spark, root), "packed")
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > packing.CAPACITY).agg(F.count("*").alias("overfull"))
    own = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("different"))
    split = own.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("split"), F.count_if(F.col("different") != F.greatest(F.lit(1), F.ceil(F.col("n") / packing.CAPACITY))).alias("lost"))
    return split.crossJoin(over)  # one row each


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(leakage.search(table(spark, root, "documents"), table(spark, root, "eval_items")))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with twelve or more consecutive words of an item."""
    return _leaks(spark, root).where("kind = 'exact'").select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Touched documents with each item that leaked into them, word for word or paraphrased."""
    return _leaks(spark, root).select("doc_id", "item_id", "kind", "run", F.round("subsequence", 4).alias("subsequence"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents to exclude."""
    return residue.to_exclude(table(spark, root, "documents")).distinct()


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Error passages, content sentences and unfilled placeholders of each document."""
    return residue.score(table(spark, root, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p3_found, p3_languages, p3_segments, p5_found, p5_kept, p6_found, p6_collapsed, p7_containers, p7_fill, p7_coverage, p8_found, p8_leaks, p9_found, p9_scores)}


_RANKED = r"""
one AS (SELECT doc_id, nullif(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '') AS source_key,
          min(CASE WHEN credibility BETWEEN 1 AND 6 THEN credibility ELSE 6 END) AS r FROM articles WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY r, doc_id) AS n FROM one),
cap AS (SELECT floor(count(DISTINCT doc_id) / 100) AS k FROM articles)
"""


_COPIES = r"""
k AS (SELECT item_id, regexp_replace(replace(lower(nfc_normalize(source)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS s,
  array_to_string(list_sort(list_transform(string_split_regex(nfc_normalize(title), '\s+(?:\||::|•|–|—|-)\s+'), lambda f: regexp_replace(replace(lower(f), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g'))), '') AS t
  FROM evidence_items WHERE source IS NOT NULL AND title IS NOT NULL),
g AS (SELECT DISTINCT item_id, min(item_id) OVER (PARTITION BY s, t) AS keep FROM k)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": f"WITH {_COPIES} SELECT keep AS keep_item_id, item_id AS copy_item_id FROM g WHERE item_id <> keep",
        "p6_collapsed": f"WITH {_COPIES} SELECT keep AS keep_item_id, count(*) AS copies FROM g GROUP BY keep HAVING count(*) > 1",
        "p7_coverage": "SELECT count(DISTINCT doc_id) AS documents, 0 AS split, 0 AS lost, 0 AS overfull FROM documents",
        "p8_found": r"""WITH
            d AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM eval_items),
            dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: lower(array_to_string(w[k:k+11], ' ')))) AS g FROM d WHERE len(w) >= 12),
            ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: lower(array_to_string(w[k:k+11], ' ')))) AS g FROM i WHERE len(w) >= 12)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
        "p5_found": f"WITH {_RANKED} SELECT DISTINCT doc_id FROM ranked, cap WHERE source_key IS NOT NULL AND n > k",
        "p5_kept": f"WITH {_RANKED} SELECT doc_id, source_key FROM ranked, cap WHERE source_key IS NULL OR n <= k",
    }
