"""Nearest vectors, related articles and text search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.functions.text import words
from newsmill.session import ship_package

#: Vectors of a block; scores that are made at once.
BLOCK, SCORES = 8192, 1 << 21


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of a table's vectors (id, vec), in the order of ids."""
    table = table.sort_by("id")
    vec = table.column("vec").combine_chunks()
    sizes, ids = pc.list_value_length(vec).to_numpy(), table.column("id").to_numpy()
    found = {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        found[d] = ids[at], vec.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
    return found


def _best_of_block(k: int, cosine: bool, others: bool):
    """For each asked vector the k best of a block by score in millionths, then by id; ``others``: not the vector of its own id."""

    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        there = _by_length(vectors)
        for d, (query_ids, q) in _by_length(asked).items():
            ids, x = there.get(d, (np.empty(0, np.int64), np.empty((0, d))))
            norms = np.sqrt((x * x).sum(1))
            step = max(1, SCORES // max(1, len(ids)))
            for start in range(0, len(query_ids) if len(ids) else 0, step):
                own, part = query_ids[start : start + step], q[start : start + step]
                scores = part @ x.T
                if cosine:
                    scores /= np.sqrt((part * part).sum(1))[:, None] * norms + 1e-9
                scores = np.floor(scores * 1e6 + 0.5) / 1e6
                if others:
                    scores[own[:, None] == ids] = -np.inf
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
                rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                order = np.lexsort((columns, -scores[rows, columns], rows))
                rows, columns = rows[order], columns[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                for kept, value in zip(out, (own[rows], ids[columns], scores[rows, columns])):
                    kept.append(value[keep])
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(out, kinds)], ["query_id", "article_id", "score"])

    return run


def _vectors(df: DataFrame, id_col: str, vec_col: str, *keys: Column) -> DataFrame:
    """(id, vec, keys …) of the vectors that can be compared."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"), *keys).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite)


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, query: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """The k rows of ``vectors`` (article_id, embedding) with the greatest inner product with each query vector (query_id, q).

    Both sides are dealt to blocks; a pair of blocks is a matrix product that leaves k rows a query, and these
    lists are merged. Scores count in millionths, ties go to the smaller id. Null vectors, vectors with null
    or non-finite entries and vectors of another length than the query's have no score.
    """
    ship_package(vectors.sparkSession)
    x, q = _vectors(vectors, "article_id", "embedding"), _vectors(query, "query_id", "q")
    blocks = [max(1, -(-df.count() // block)) for df in (x, q)]
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.withColumn("xb", own(blocks[0])).withColumn("qb", each(blocks[1]))
    q = q.withColumn("qb", own(blocks[1])).withColumn("xb", each(blocks[0]))
    pairs = q.groupBy("qb", "xb").cogroup(x.groupBy("qb", "xb"))
    return _merged(pairs.applyInArrow(_best_of_block(k, False, False), "query_id long, article_id long, score double"), k)


def related(articles: DataFrame, topic: str, k: int = 5, most: int = 50, block: int = BLOCK) -> DataFrame:
    """For each article the k most similar among its topic's ``most`` newest others (article_id, created_at, embedding, topic).

    A topic's articles are dealt to blocks, and each block meets the topic's newest in a matrix product.
    """
    ship_package(articles.sparkSession)
    newest = Window.partitionBy(topic).orderBy(F.desc("created_at"), F.desc("article_id"))
    pool = articles.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most)
    blocks = articles.groupBy(F.col(topic).alias("topic")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    asked = _vectors(articles.where(F.col(topic).isNotNull()), "article_id", "embedding", F.col(topic).alias("topic")).join(blocks, "topic")
    asked = asked.withColumn("b", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks")
    pool = _vectors(pool.where(F.col(topic).isNotNull()), "article_id", "embedding", F.col(topic).alias("topic")).join(blocks, "topic")
    pool = pool.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    pairs = asked.groupBy("topic", "b").cogroup(pool.groupBy("topic", "b"))
    found = pairs.applyInArrow(_best_of_block(k, True, True), "query_id long, article_id long, score double")
    return _merged(found, k).select(F.col("query_id").alias("article_id"), F.col("article_id").alias("related_id"), "score", "rank")


def text_search(articles: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """Articles that hold any of the query's words, scored by weighted counts of them in each field."""
    terms = sorted(set(query.lower().split()))
    score = sum((F.lit(w) * F.size(F.filter(words(F.lower(F.coalesce(c, F.lit("")))), lambda x: x.isin(*terms))) for c, w in weights.items()), F.lit(0.0))
    return articles.withColumn("score", score).where(F.col("score") > 0)


def _near(term: str, typos: int):
    return lambda x: F.levenshtein(x, F.lit(term), typos) >= 0 if typos else x == term


def fuzzy_search(articles: DataFrame, query: str, field: str) -> DataFrame:
    """Articles with each of the query's words up to one typo (five letters and more) or two (nine and more), marked."""
    out, tokens = articles, F.split(F.lower(F.col(field)), r"(?U)[^\w]+")
    hits = []
    for term in query.lower().split():
        typos = 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0
        near = _near(term, typos)
        hits.append(F.filter(tokens, near))
        out = out.where(F.exists(tokens, near))
    found = F.array_distinct(F.concat(*hits))
    return out.withColumn("highlighted", F.aggregate(found, F.col(field), lambda s, w: F.regexp_replace(s, F.concat(F.lit(r"(?iU)\b("), w, F.lit(r")\b")), F.lit("<mark>$1</mark>"))))
