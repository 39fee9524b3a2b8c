"""Lexical and vector retrieval over whole tables, for many questions at once.

The questions are the stated query set; corpus statistics cover all documents. Only the questions' terms become postings,
and vectors meet the questions as one matrix product per Arrow batch, so no row is ever made for each pair of question
and document. What a ranking needs of the pairs it doesn't keep is counts: how many scores lie above a given one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import registries as R
from factloom.durable import cut
from factloom.functions import text, vectors
from factloom.operators import intervals
from factloom.sources import pages as page_source

#: Scores are sums of whole numbers of one such part.
UNIT = 1e9
#: Numbers in the matrix of the questions' vectors that every task holds; more questions are refused.
MATRIX = 50_000_000


def postings(docs: DataFrame, ident: str, body: str, terms: DataFrame | None = None) -> DataFrame:
    """(ident, term, tf, dl) of every term of a text, or of `terms` (term; distinct) only."""
    bags = docs.select(F.col(ident), text.tokens(F.col(body)).alias("_t"))
    rows = bags.select(ident, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term")
    return rows.groupBy(ident, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_statistics(docs: DataFrame, body: str) -> tuple[DataFrame, DataFrame]:
    """(df: term, df; statistics: one row n, avgdl, mean_idf over all terms), read in one pass: every text gives each of its
    terms once, and an empty term that counts texts and words. Texts without any term count as documents."""
    # lengths and distinct terms are columns before the explosion, or every row of it would read the text again
    bags = docs.select(text.tokens(F.col(body)).alias("_t")).select(F.size("_t").alias("_dl"), F.array_append(F.array_distinct("_t"), F.lit("")).alias("_d"))
    rows = bags.select("_dl", F.explode("_d").alias("term"))
    counted = cut(rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("_dl")).otherwise(0)).alias("_words")), "terms")
    n = counted.where("term = ''").select(F.col("df").alias("n"), (F.col("_words") / F.col("df")).alias("avgdl"))
    df = counted.where("term <> ''").select("term", "df")
    stats = df.crossJoin(F.broadcast(n)).groupBy("n", "avgdl").agg(F.avg(_idf(F.col("n"), F.col("df"))).alias("mean_idf"))  # n: one row
    return df, stats


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def bm25(docs: DataFrame, queries: DataFrame, ident: str = "doc_id", body: str = "text", query: str = "query_id", query_text: str = "query") -> DataFrame:
    """(query, ident, score) of the documents that share a term with a question.

    Repeated terms of a question count repeatedly; terms in more than half of all documents count EPSILON times the mean.
    Contributions are whole numbers of 1/UNIT, so sums don't depend on order. Other documents have score 0."""
    terms = cut(queries.select(query, F.explode(text.tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times")), "question-terms")
    wanted = terms.select("term").distinct()
    df, stats = corpus_statistics(docs, body)
    weighted = df.join(wanted, "term", "left_semi").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.when(_idf(F.col("n"), F.col("df")) < 0, R.BM25_EPSILON * F.col("mean_idf")).otherwise(_idf(F.col("n"), F.col("df")))
    k1, b = R.BM25_K1, R.BM25_B
    # what a term gives a document doesn't depend on the question, so it is worked out before questions multiply it
    given = postings(docs, ident, body, wanted).join(weighted.select("term", "avgdl", idf.alias("idf")), "term")
    worth = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = given.select(ident, "term", (worth * UNIT).alias("_worth")).join(terms, "term")
    total = F.sum(F.round(F.col("times") * F.col("_worth")).cast("bigint"))
    # written once: fills, ranks and joins above read it several times
    return cut(hit.groupBy(query, ident).agg((total / F.lit(UNIT)).alias("score")), "scores")


def top_k(scored: DataFrame, docs: DataFrame, k: int, ident: str = "doc_id", query: str = "query_id", queries: DataFrame | None = None) -> DataFrame:
    """(query, ident, score, rank) of each question's k best, score descending, then identifier.

    Questions with fewer than k matches are filled with unmatched documents at score 0: the 2k smallest identifiers are
    enough for that, since fewer than k of them can be matched."""
    rows = scored
    if queries is not None:
        spare = docs.select(ident).distinct().orderBy(ident).limit(2 * k)
        rows = _filled(scored, queries, spare, k, ident, query)
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), ident))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _filled(scored: DataFrame, queries: DataFrame, spare: DataFrame, k: int, ident: str, query: str) -> DataFrame:
    """`scored` with the unmatched documents of `spare` at score 0, for the questions with fewer than k matches."""
    short = queries.select(query).distinct().join(scored.groupBy(query).agg(F.count("*").alias("_n")), query, "left").where(f"coalesce(_n, 0) < {k}").select(query)
    fill = short.join(spare, F.lit(True)).join(scored.select(query, ident), [query, ident], "left_anti")  # questions x a bounded list
    return scored.unionByName(fill.withColumn("score", F.lit(0).cast(scored.schema["score"].dataType)), allowMissingColumns=True)


def competition_ranks(scored: DataFrame, query: str = "query_id", score: str = "score", out: str = "rank") -> DataFrame:
    """Equal scores share the smallest rank."""
    return intervals.competition_ranks(scored, query, score, out)


class Dense:
    """Cosines of documents (ident, vector) with the questions' vectors (query, query_vector), never as rows of all pairs.

    Documents and questions without a vector, or of another length than the questions', take no part; a vector without
    length has cosine 0 with all. Cosines count as rounded to nine places. The questions are the stated query set; their
    matrix is refused beyond MATRIX numbers."""

    def __init__(self, docs: DataFrame, queries: DataFrame, ident: str = "doc_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "vector"):
        self.ident, self.vector, self.query = ident, vector, query
        rows = queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0)).select(query, query_vector).distinct()
        size = rows.agg(F.coalesce(F.sum(F.size(query_vector)), F.lit(0)).alias("n")).first().n
        if size > MATRIX:
            raise ValueError(f"{size} numbers in the questions' vectors; ask in parts of at most {MATRIX}")
        own = rows.orderBy(query).collect()
        self.queries = [r[0] for r in own]
        width = len(own[0][1]) if own else 0
        if any(len(r[1]) != width for r in own):
            raise ValueError("the questions' vectors differ in length")
        matrix = np.array([r[1] for r in own], dtype=np.float64).reshape(len(own), width)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = docs.sparkSession.sparkContext.broadcast(matrix / np.where(norm == 0, 1, norm))
        self.docs = docs.where(F.col(vector).isNotNull() & (F.size(vector) == width)).select(ident, vector)
        self.kind = docs.schema[ident].dataType.simpleString()
        self.query_kind = queries.schema[query].dataType.simpleString()

    def _scores(self) -> Callable[[pd.DataFrame], np.ndarray]:
        """A function of a batch of documents that gives their cosines with all questions."""
        matrix, vector = self.matrix, self.vector

        def scores(batch: pd.DataFrame) -> np.ndarray:
            m = np.stack(batch[vector].to_list()).astype(np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.round((m / np.where(norm == 0, 1, norm)) @ matrix.value.T, 9)

        return scores

    def top(self, n: int) -> DataFrame:
        """(query, ident, score, rank) of the documents whose competition rank is n or less."""
        queries, ident, query, scores = self.queries, self.ident, self.query, self._scores()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b) or not queries:
                    continue
                s = scores(b)
                least = np.partition(s, -n, axis=0)[-n] if n < len(s) else s.min(axis=0)
                row, col = np.nonzero(s >= least)
                yield pd.DataFrame({query: np.array(queries, dtype=object)[col], ident: b[ident].to_numpy()[row], "score": s[row, col]})

        found = self.docs.mapInPandas(run, f"{query} {self.query_kind}, {ident} {self.kind}, score double")
        rank = F.rank().over(Window.partitionBy(query).orderBy(F.desc("score")))
        return found.withColumn("rank", rank).where(F.col("rank") <= n)

    def above(self, asked: DataFrame) -> DataFrame:
        """(query, ident, score, rank) of the pairs `asked` (query, ident; a bounded number for each question) that have a
        cosine: their scores, then how many of all documents score higher."""
        queries, ident, query, scores = self.queries, self.ident, self.query, self._scores()
        at = {q: k for k, q in enumerate(queries)}
        wanted = asked.groupBy(ident).agg(F.collect_list(query).alias("_q"))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and queries:
                    s = scores(b)
                    rows = [(q, i, s[n, at[q]]) for n, (i, qs) in enumerate(zip(b[ident], b["_q"], strict=True)) for q in qs if q in at]
                    yield pd.DataFrame(rows, columns=[query, ident, "score"])

        scored = cut(self.docs.join(wanted, ident).mapInPandas(score, f"{query} {self.query_kind}, {ident} {self.kind}, score double"), "asked-scores")
        marks = {r[0]: np.array(sorted(set(r[1]))) for r in scored.groupBy(query).agg(F.collect_set("score")).collect()}  # a bounded number a question
        counts = higher(self.docs, marks, lambda b: (queries, scores(b)), query, self.query_kind)
        return scored.join(counts, [query, "score"]).select(query, ident, "score", "rank")


def higher(rows: DataFrame, marks: dict, scores_of, query: str, query_kind: str) -> DataFrame:
    """(query, score, rank) of each mark: one more than the scores above it, counted in one pass over `rows`. `scores_of`
    turns a batch into (questions, matrix of scores)."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            if not len(b):
                continue
            queries, s = scores_of(b)
            for k, q in enumerate(queries):
                m = shared.value.get(q)
                if m is not None:
                    # a score lies above the first of so many marks
                    total[q] = total.get(q, 0) + np.bincount(np.searchsorted(m, s[:, k], side="left"), minlength=len(m) + 1)
        out = [(q, float(m), int(n)) for q, t in total.items() for m, n in zip(shared.value[q], t[::-1].cumsum()[::-1][1:], strict=True)]
        yield pd.DataFrame(out, columns=[query, "score", "n"])

    return rows.mapInPandas(count, f"{query} {query_kind}, score double, n bigint").groupBy(query, "score").agg((F.sum("n") + 1).alias("rank"))


def dense(docs: DataFrame, queries: DataFrame, k: int, ident: str = "doc_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query, ident, score, rank) of each question's documents of competition rank k or less by cosine."""
    return Dense(docs, queries, ident, vector, query, query_vector).top(k)


def fuse(lexical: DataFrame, semantic: Dense, docs: DataFrame, queries: DataFrame, k: int, ident: str = "doc_id", query: str = "query_id", rrf: int = R.RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query, ident, score, rank) of the k best.

    Every document has a lexical rank (those without a shared term share the one after the last match), those with a
    vector also a semantic one. A document of rank n + 1 or more in both rankings scores at most 2 / (rrf + n + 1), any of
    a ranking's first k at least 1 / (rrf + k); so with n = rrf + 2k the k best are among the first n of either ranking.
    These lists, with all ties at their end, are fused; what they lack of the other ranking's ranks is counted."""
    n = rrf + 2 * k
    matched = lexical.where("score > 0")
    rank = F.rank().over(Window.partitionBy(query).orderBy(F.desc("score")))
    lex = matched.withColumn("_lex", rank).where(F.col("_lex") <= n).select(query, ident, F.col("_lex").cast("bigint").alias("_lex"))
    sem = cut(semantic.top(n).select(query, ident, F.col("rank").cast("bigint").alias("_sem")), "semantic")
    lex = cut(lex, "lexical")
    # lexical ranks of the semantic list's documents
    score_of = sem.join(lex, [query, ident], "left_anti").select(query, ident).join(matched, [query, ident])
    marks = {r[0]: np.array(sorted(set(r[1]))) for r in score_of.groupBy(query).agg(F.collect_set("score")).collect()}  # n a question, and ties
    query_kind = queries.schema[query].dataType.simpleString()
    if marks:
        def one_by_one(b: pd.DataFrame) -> tuple[list, np.ndarray]:
            own = list(dict.fromkeys(b[query].tolist()))
            return own, np.stack([np.where(b[query] == q, b["score"], -np.inf) for q in own], axis=1)

        counted = higher(matched, marks, one_by_one, query, query_kind)
        late = score_of.join(counted, [query, "score"]).select(query, ident, F.col("rank").alias("_lex"))
        lex = lex.unionByName(late)
    # semantic ranks of the lexical list's documents
    more = lex.join(sem, [query, ident], "left_anti").select(query, ident)
    sem = sem.unionByName(semantic.above(more).select(query, ident, F.col("rank").alias("_sem")))
    unmatched = queries.select(query).distinct().join(matched.groupBy(query).agg((F.count("*") + 1).alias("_rest")), query, "left").select(query, F.coalesce("_rest", F.lit(1)).alias("_rest"))
    # where few match, the rest share a rank that may be among the first n: those without a vector come by identifier
    spare = docs.select(ident).distinct().orderBy(ident).limit(2 * n)
    few = unmatched.where(F.col("_rest") <= n).select(query).join(spare, F.lit(True)).join(lex.select(query, ident), [query, ident], "left_anti").join(sem.select(query, ident), [query, ident], "left_anti")
    few = cut(few, "fused-spare")
    sem = sem.unionByName(semantic.above(few).select(query, ident, F.col("rank").alias("_sem")))
    both = lex.join(sem, [query, ident], "full").join(few.withColumn("_few", F.lit(True)), [query, ident], "full").join(unmatched, query)
    score = F.lit(1.0) / (rrf + F.coalesce("_lex", "_rest")) + F.coalesce(F.lit(1.0) / (rrf + F.col("_sem")), F.lit(0.0))
    return top_k(both.select(query, ident, F.round(score, 12).alias("score")), docs, k, ident, query)


def diverse(scored: DataFrame, k: int, per_source: int = R.PER_SOURCE, ident: str = "doc_id", query: str = "query_id", source: str = "source") -> DataFrame:
    """Of all scored documents the k best of each question (score descending, then identifier) with at most `per_source` of
    a source, filled up by rank from the others if too few; 0 or less: no limit. Adds `pick`, the place in the selection.

    All are ranked before anything is chosen. No source can give more than its k best, so only these leave its ranking."""
    order = [F.desc("score"), F.col(ident)]
    nth = F.row_number().over(Window.partitionBy(query, source).orderBy(*order))
    late = (F.col("_nth") > per_source) if per_source > 0 else F.lit(False)
    place = F.row_number().over(Window.partitionBy(query).orderBy(late, *order))
    return scored.withColumn("_nth", nth).where(F.col("_nth") <= k).withColumn("pick", place).where(F.col("pick") <= k).drop("_nth")


def diverse_with_rest(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int, per_source: int = R.PER_SOURCE, ident: str = "doc_id", query: str = "query_id", source: str = "source") -> DataFrame:
    """diverse() over scored and, where a question has fewer than k matches within the limit, unmatched documents at score
    0: of each source its 2k smallest identifiers, of which fewer than k can be matched."""
    own = scored.join(docs.select(ident, source), ident)
    nth = F.row_number().over(Window.partitionBy(source).orderBy(ident))
    spare = docs.select(ident, source).withColumn("_n", nth).where(F.col("_n") <= 2 * k).drop("_n")
    within = own.groupBy(query, source).agg(F.least(F.count("*"), F.lit(per_source if per_source > 0 else k)).alias("_n")).groupBy(query).agg(F.sum("_n").alias("_n"))
    short = queries.select(query).distinct().join(within, query, "left").where(f"coalesce(_n, 0) < {k}").select(query)
    fill = short.join(spare, F.lit(True)).join(scored.select(query, ident), [query, ident], "left_anti").withColumn("score", F.lit(0).cast(scored.schema["score"].dataType))
    return diverse(own.select(query, ident, source, "score").unionByName(fill.select(query, ident, source, "score")), k, per_source, ident, query, source)


def gather(docs: DataFrame, queries: DataFrame, sources: DataFrame, k: int = R.CONTEXT_ITEMS, per_source: int = R.PER_SOURCE, pages: DataFrame | None = None, encode=None, dim: int = 64) -> DataFrame:
    """Evidence for each question: lexical and vector rankings fused, source limit, thin documents filled from their pages
    (url, html), grades, then (after the cut) the subject filter.

    `docs`: doc_id, title, summary, source, credibility, url and, where it is known, embedding; documents without one are
    encoded by `encode` (text to vector; the hashing encoder unless given), as are the questions."""
    encode = encode or vectors.hash_embedding(dim)
    body = docs.withColumn("text", text.document_text(F.col("title"), F.col("summary")))
    if "embedding" not in docs.columns:
        body = body.withColumn("embedding", F.lit(None).cast("array<float>"))
    body = cut(body.withColumn("embedding", F.coalesce("embedding", encode(F.when(F.col("embedding").isNull(), F.col("text"))))), "encoded")
    asked = queries.select("query_id", "query", encode("query").alias("vector"))
    lexical = bm25(body, queries)
    picked = cut(_picked(lexical, body, asked, k, per_source), "picked").drop("source").join(docs, "doc_id")
    if pages is not None:
        picked = picked.drop("summary").join(page_source.hydrate(picked.select("doc_id", "url", "summary").distinct(), pages).select("doc_id", "summary"), "doc_id")
    grade = sources.select(F.lower(F.trim("label")).alias("_s"), F.col("reliability").alias("_g"))
    rated = picked.withColumn("_s", F.lower(F.trim("source"))).join(grade, "_s", "left").withColumn("reliability", F.coalesce("_g", F.lit("F")))
    subject = queries.select("query_id", text.relevance_tokens(F.col("query")).alias("_q"))
    own = text.singular_forms(text.content_tokens(F.concat_ws(" ", "title", "summary")))
    kept = rated.join(subject, "query_id").where((F.size("_q") == 0) | F.arrays_overlap("_q", own))
    return kept.select("query_id", "doc_id", "title", "source", "reliability", "credibility", "summary", "pick")


def _picked(lexical: DataFrame, body: DataFrame, asked: DataFrame, k: int, per_source: int) -> DataFrame:
    """diverse() over the fused ranking of all documents, of which only as much is made as the source limit needs: when the
    first n hold k documents within the limit, nothing after them can be picked. Questions that aren't done go on with a
    longer list, in the end with all documents."""
    total = body.count()
    n, parts = 8 * k, []
    named = body.select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    while True:
        own = lexical.join(asked.select("query_id"), "query_id", "left_semi")
        ranked = cut(fuse(own, Dense(body, asked), body, asked, min(n, max(k, total))).join(named, "doc_id"), "fused")
        per = ranked.groupBy("query_id", "source").agg(F.count("*").alias("_n"))
        within = per.groupBy("query_id").agg(F.sum(F.least("_n", F.lit(per_source)) if per_source > 0 else F.col("_n")).alias("_within"))
        done = within.where(F.lit(n >= total) | (F.col("_within") >= k)).select("query_id")
        parts.append(diverse(ranked.drop("rank").join(done, "query_id", "left_semi"), k, per_source))
        left = asked.join(done, "query_id", "left_anti")
        if n >= total or left.isEmpty():
            break
        asked, n = cut(left, "asked"), 8 * n
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
