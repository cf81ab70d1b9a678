"""A persisted search index: ranked words with stems (BM25), and words with typos over several fields.

``build`` writes Parquet tables below one path, each file sorted by its key, so a search for a few
keys reads the row groups that may hold them:

``articles``  a row an article: id, block, length, and the columns that filter, sort or show
``stems``     postings of stems: a row a stem and block with the block's articles, their shares and the greatest share
``terms``     a row a stem: how many articles hold it
``words``     postings of words as written: a row a word, field and block with the block's articles
``typos``     keys of the vocabulary: a word and each of its first letters' subsequences with up to two letters removed

A block is a range of ids, so an article's postings of all stems lie in the blocks of one number. Articles are dealt by
block once a kind of search; their words are counted, and gathered into postings, where they are. The share of an article in
a stem is BM25's quotient without the stem's weight, which the search multiplies.

A search brings the postings of all asked keys in a block together with the queries: a task adds up the block's scores
query by query in one array and hands on a query's k best only, so no row a query and article is ever made, and what is
shuffled is the asked postings once, and each query once a block. One of ``SEEDS`` blocks goes first: the k-th best score
found there is a query's threshold, and of the other blocks only scores that reach it are handed on; blocks whose greatest
shares can't reach it aren't scored. The rows are those of scoring everything.

Words with typos: two words within d edits share a subsequence of their first ``PREFIX`` letters with at most d
letters removed on each side (an insertion, deletion or substitution costs one letter of it, and cutting both to
the same length costs no more). So candidates are an equi-join of keys, verified by edit distance; a word
has at most 29 keys, however long it is. Keys are kept as hashes.

Defined cases: null fields have no words; an article without words matches nothing; rows that repeat an id are one article whose
words add up; a query without words has no rows; words that no article holds are left out of a ranked search, and
leave a search with typos without rows, as it needs every word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsmill.functions.stems import weak_stem, word_list
from newsmill.operators.engagement import half_up
from newsmill.session import materialize, ship_package

K1, B = 1.2, 0.75
#: Ids of a block; of so many blocks one is scored first; distinct keys that a search names in its scan's filter.
BLOCK_IDS, SEEDS, NAMED_KEYS = 8192, 16, 10_000
#: Letters from which typo keys are made; lengths from which a word may have one typo or two.
PREFIX, ONE_TYPO, TWO_TYPOS = 7, 5, 9


def _by_block(articles: DataFrame, fields: dict[str, float], block_ids: int) -> DataFrame:
    """Rows (block, id, fields …), those of a block in one partition: what is then grouped by block and more needs no other exchange."""
    rows = articles.select(F.floor(F.col("article_id") / block_ids).alias("block"), F.col("article_id").alias("id"), *fields)
    return rows.repartition("block")


def removals(word: str, most: int, prefix: int = PREFIX) -> set[str]:
    """The subsequences of a word's first letters with up to ``most`` removed."""
    head = word[:prefix]
    return {"".join(left) for k in range(min(most, len(head)) + 1) for left in combinations(head, len(head) - k)}


def allowed_typos(n: Column) -> Column:
    return F.when(n >= TWO_TYPOS, 2).when(n >= ONE_TYPO, 1).otherwise(0)


def _removal_keys(word: Column, most: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(words: pa.Array, limits: pa.Array) -> pa.Array:
        return pa.array([sorted(removals(w, k)) for w, k in zip(words.to_pylist(), limits.to_pylist())], pa.list_(pa.string()))

    return run(word, most)


def build(articles: DataFrame, path: str, fields: dict[str, float], carry: tuple[str, ...] = (), block_ids: int = BLOCK_IDS, stem: Callable[[Column], Column] = weak_stem, searches: tuple[str, ...] = ("ranked", "typos")) -> SearchIndex:
    """Index ``articles`` (article_id, fields …, carried columns): ``fields`` and their weights in ranked searches; ``searches``: which of the two it shall serve."""
    spark = articles.sparkSession
    ship_package(spark)
    lists = [word_list(F.col(f)) for f in fields]
    length = sum((F.size(x) * F.lit(float(w)) for x, w in zip(lists, fields.values())), F.lit(0.0))
    rows = articles.select(F.floor(F.col("article_id") / block_ids).alias("block"), F.col("article_id").alias("id"), length.alias("length"), *carry)
    listed = rows.repartition("block").groupBy("block", "id").agg(F.sum("length").alias("length"), *[F.first(c).alias(c) for c in carry])
    listed.sortWithinPartitions("id").write.parquet(f"{path}/articles")
    n, mean = spark.read.parquet(f"{path}/articles").agg(F.count(F.lit(1)), F.avg("length")).first()
    spark.createDataFrame([(n, mean or 0.0, block_ids, list(fields))], "n long, mean double, block_ids int, fields array<string>").coalesce(1).write.parquet(f"{path}/stats")
    if "ranked" in searches:
        _ranked_tables(articles, path, fields, block_ids, stem, mean or 1.0)
    if "typos" in searches:
        _typo_tables(articles, path, fields, block_ids)
    return SearchIndex(spark, path, stem)


def _ranked_tables(articles: DataFrame, path: str, fields: dict[str, float], block_ids: int, stem: Callable[[Column], Column], mean: float) -> None:
    spark = articles.sparkSession
    lengths = spark.read.parquet(f"{path}/articles").select("block", "id", "length").repartition("block")
    rows = _by_block(articles, fields, block_ids).join(lengths, ["block", "id"])
    weighed = lambda f, g: F.transform(word_list(F.col(f)), lambda w: F.struct(w.alias("word"), F.lit(float(g)).alias("g")))
    each = rows.select("block", "id", "length", F.explode(F.flatten(F.array(*[weighed(f, g) for f, g in fields.items()]))).alias("t"))
    stems = each.groupBy("block", "id", "length", stem(F.col("t.word")).alias("term")).agg(F.sum("t.g").alias("tf"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    postings = stems.select("term", "block", F.struct("id", share.alias("share")).alias("p")).groupBy("block", "term").agg(F.array_sort(F.collect_list("p")).alias("p"))
    arrays = [F.transform("p", lambda x: x["id"]).alias("ids"), F.transform("p", lambda x: x["share"]).alias("shares")]
    best = F.array_max(F.transform("p", lambda x: x["share"])).alias("best")
    postings.select("term", "block", best, *arrays).sortWithinPartitions("term", "block").write.parquet(f"{path}/stems")
    terms = spark.read.parquet(f"{path}/stems").groupBy("term").agg(F.sum(F.size("ids")).alias("holders"))
    terms.sortWithinPartitions("term").write.parquet(f"{path}/terms")


def _typo_tables(articles: DataFrame, path: str, fields: dict[str, float], block_ids: int) -> None:
    spark = articles.sparkSession
    of_field = lambda f, i: F.transform(F.array_distinct(word_list(F.col(f))), lambda w: F.struct(w.alias("word"), F.lit(i).alias("field")))
    each = _by_block(articles, fields, block_ids).select("block", "id", F.explode(F.flatten(F.array(*[of_field(f, i) for i, f in enumerate(fields)]))).alias("t"))
    words = each.groupBy("block", F.col("t.word").alias("word"), F.col("t.field").alias("field")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    words.select("word", "field", "block", "ids").sortWithinPartitions("word", "field", "block").write.parquet(f"{path}/words")
    vocabulary = spark.read.parquet(f"{path}/words").select("word").distinct()
    size = F.char_length("word")
    # A word may be reached by a query word that is longer by its typos.
    most = F.when(size >= TWO_TYPOS - 2, 2).when(size >= ONE_TYPO - 1, 1).otherwise(0)
    keys = vocabulary.select(F.explode(_removal_keys(F.col("word"), most)).alias("key"), "word").select(F.xxhash64("key").alias("key"), "word")
    # Dealt by hash, as the sampling of ranges would make the keys twice; each key is in one file, sorted there.
    keys.repartition("key").sortWithinPartitions("key", "word").write.parquet(f"{path}/typos")


# --- a block's articles against queries, as tasks do it

FOUND = "query_id long, article_id long, score double"
MATCHED = "query_id long, id long, typos int, field int, words array<string>"


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """A column of lists as views of their values; null lists are empty."""
    out = []
    for part in column.chunks:
        values, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        out += [values[i:j] for i, j in zip(ends[:-1], ends[1:])]
    return out


def _score_block(block_ids: int, k: int, chosen: bool):
    """The k best articles of a block for each query that reach the query's ``least``; with ``chosen``, among those that a posting without a term lists."""

    def run(key: tuple, postings: pa.Table, asks: pa.Table) -> pa.Table:
        first = key[0].as_py() * block_ids
        own, among = {}, np.zeros(block_ids, bool) if chosen else None
        columns = zip(postings["t"].to_pylist(), postings["weight"].to_pylist(), postings["best"].to_pylist(), _lists(postings["ids"]), _lists(postings["shares"]))
        for t, weight, best, ids, shares in columns:
            if t is None:
                among[ids - first] = True
            else:
                own[t] = (ids - first, weight * shares, weight * best)
        score, held = np.zeros(block_ids), np.zeros(block_ids, bool)
        queries, places, scores = [], [], []
        for query, terms, least in zip(asks["query_id"].to_pylist(), _lists(asks["terms"]), asks["least"].to_pylist()):
            has = [own[t] for t in terms.tolist() if t in own]
            # Scores that round to the same millionth are ties, so they may miss the threshold by as much.
            if not has or least is not None and sum(h[2] for h in has) < least - 2e-6:
                continue
            score[:], held[:] = 0.0, False
            for ids, shares, _ in has:
                score[ids] += shares
                held[ids] = True
            if chosen:
                held &= among
            if least is not None:
                held &= score >= least - 2e-6
            at = np.flatnonzero(held)
            rounded = np.floor(score[at] * 1e6 + 0.5)
            if len(at) > k:
                near = rounded >= np.partition(rounded, len(at) - k)[len(at) - k]
                at, rounded = at[near], rounded[near]
            at = at[np.lexsort((at, -rounded))[:k]]
            if len(at):
                queries.append(np.full(len(at), query, np.int64))
                places.append(at + first)
                scores.append(score[at])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
        return pa.table([join(queries, np.int64), join(places, np.int64), join(scores, np.float64)], ["query_id", "article_id", "score"])

    return run


def _match_block(block_ids: int, k: int, n_fields: int, with_words: bool):
    """The k first articles of a block that hold each of a query's words with typos; the posting without a word lists the articles that may be found and their ranks by age."""

    def run(key: tuple, postings: pa.Table, asks: pa.Table) -> pa.Table:
        first = key[0].as_py() * block_ids
        age = np.full(block_ids, -1, np.int64)
        own: dict[str, list] = {}
        none = np.iinfo(np.int32).max
        for term, word, cost, ids, ages in zip(*(postings[c].to_pylist() for c in ("term", "word", "cost")), _lists(postings["ids"]), _lists(postings["ages"])):
            if term is None:
                age[ids - first] = ages
            else:
                own.setdefault(term, []).append((cost, ids - first, word))
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for term, lists in own.items():
            best = np.full(block_ids, none, np.int32)
            for cost, ids, _ in lists:
                best[ids] = np.minimum(best[ids], cost)
            at = np.flatnonzero((best < none) & (age >= 0))
            held[term] = (at.astype(np.int32), best[at])
        dense = np.full(block_ids, none, np.int32)
        out = []
        for query, terms in zip(asks["query_id"].to_pylist(), asks["terms"].to_pylist()):
            has = sorted((held[t] for t in terms if t in held), key=lambda h: len(h[0]))
            if len(has) < len(terms) or not len(has[0][0]):
                continue
            at, cost = has[0]
            typos, field = cost // n_fields, cost % n_fields
            for ids, costs in has[1:]:
                dense[ids] = costs
                other = dense[at]
                dense[ids] = none
                both = other < none
                at, other = at[both], other[both]
                typos, field = typos[both] + other // n_fields, np.minimum(field[both], other % n_fields)
            order = np.lexsort((at, age[at], field, typos))[:k]
            if len(order):
                at = at[order]
                words = [sorted({w for t in terms for _, ids, w in own[t] if (p := np.searchsorted(ids, i)) < len(ids) and ids[p] == i}) for i in at] if with_words else [None] * len(at)
                out.append((np.full(len(at), query, np.int64), at.astype(np.int64) + first, typos[order].astype(np.int32), field[order].astype(np.int32), words))
        join = lambda c, kind: pa.array(np.concatenate([x[c] for x in out]) if out else np.zeros(0, kind))
        columns = [join(0, np.int64), join(1, np.int64), join(2, np.int32), join(3, np.int32), pa.array([w for x in out for w in x[4]], pa.list_(pa.string()))]
        return pa.table(columns, ["query_id", "id", "typos", "field", "words"])

    return run


@dataclass(frozen=True)
class SearchIndex:
    """Searches an index that :func:`build` wrote. Queries are a frame (query_id, query)."""

    spark: SparkSession
    path: str
    stem: Callable[[Column], Column] = weak_stem

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _asked(self, name: str, key: str, asked: DataFrame) -> DataFrame:
        """A table's rows whose key is asked for. Up to ``NAMED_KEYS`` keys reach the scan as its filter, which skips row groups; more are joined alone."""
        keys = asked.select(key).distinct()
        named = [r[0] for r in keys.limit(NAMED_KEYS + 1).collect()]
        rows = self.table(name)
        return rows.where(F.col(key).isin(named)) if len(named) <= NAMED_KEYS else rows.join(keys, key, "left_semi")

    def _blocks(self) -> DataFrame:
        return self.table("articles").select("block").distinct()

    def ranked(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """(query_id, article_id, score, rank): the k best articles by BM25 that hold any of a query's stems; ``where`` is a condition on carried columns."""
        ship_package(self.spark)
        stats = self.table("stats").first()
        words = queries.select("query_id", F.explode(word_list(F.col("query"))).alias("word"))
        asked = materialize(words.select("query_id", self.stem(F.col("word")).alias("term")).distinct(), "asked-terms")
        weight = F.log1p((F.lit(float(stats.n)) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
        known = materialize(self._asked("terms", "term", asked).select("term", weight.alias("weight"), F.monotonically_increasing_id().alias("t")), "weighted-terms")
        postings = self._asked("stems", "term", known).join(known, "term").select("block", "t", "weight", "best", "ids", "shares")
        if where is not None:
            kept = self.table("articles").where(where).groupBy("block").agg(F.collect_list("id").alias("ids"))
            postings = postings.unionByName(kept.select("block", "ids"), allowMissingColumns=True)
        wanted = materialize(asked.join(known, "term").groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("terms")), "asked-stems")

        def scores(pilots: bool, asks: DataFrame) -> DataFrame:
            one = (F.pmod("block", F.lit(SEEDS)) == 0) == F.lit(pilots)
            here = self._blocks().where(one).crossJoin(asks).select("block", "query_id", "terms", "least")
            return postings.where(one).groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_score_block(stats.block_ids, k, where is not None), FOUND)

        best = Window.partitionBy("query_id").orderBy(F.desc(half_up(F.col("score"), 6)), "article_id")
        first = materialize(scores(True, wanted.withColumn("least", F.lit(None).cast("double"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first-scores")
        threshold = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        every = first.drop("rank").unionByName(scores(False, wanted.join(threshold, "query_id", "left")))
        return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "article_id", half_up(F.col("score"), 6).alias("score"), "rank")

    def near_words(self, asked: DataFrame) -> DataFrame:
        """(term, word, typos): the vocabulary's words within the typos that a term's length allows; ``asked``: term."""
        ship_package(self.spark)
        limited = asked.select("term").distinct().withColumn("most", allowed_typos(F.char_length("term")).cast("int"))
        keys = materialize(limited.select("term", "most", F.explode(_removal_keys(F.col("term"), F.col("most"))).alias("key")).withColumn("key", F.xxhash64("key")), "asked-keys")
        pairs = self._asked("typos", "key", keys).join(keys, "key").select("term", "word", "most").distinct()
        return pairs.withColumn("typos", F.levenshtein("term", "word", 2)).where("typos >= 0 AND typos <= most").select("term", "word", "typos")

    def with_typos(self, queries: DataFrame, k: int = 20, where: Column | None = None, newest: str = "created_at", show: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, article_id, typos, field, rank, shown fields with the matches marked).

        Articles that hold each of a query's words in any field, with typos by length. Fewer typos
        come first (of each word its best match), then the first field among these, then the newest ``newest``, then the smallest id.
        """
        stats = self.table("stats").first()
        asked = queries.select("query_id", F.explode(F.array_distinct(word_list(F.col("query")))).alias("term")).distinct()
        asked = materialize(asked, "asked-words")
        near = materialize(self.near_words(asked), "near-words")
        cost = F.col("typos") * len(stats.fields) + F.col("field")
        postings = self._asked("words", "word", near).join(near, "word").select("block", "term", "word", cost.cast("int").alias("cost"), "ids")
        listed = self.table("articles") if where is None else self.table("articles").where(where)
        aged = listed.select("block", "id", F.dense_rank().over(Window.partitionBy("block").orderBy(F.desc(newest))).cast("long").alias("age"))
        ages = aged.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "age"))).alias("p"))
        ages = ages.select("block", F.transform("p", lambda x: x["id"]).alias("ids"), F.transform("p", lambda x: x["age"]).alias("ages"))
        wanted = materialize(asked.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms")), "asked-words")
        here = self._blocks().crossJoin(wanted).select("block", "query_id", "terms")
        both = postings.unionByName(ages, allowMissingColumns=True)
        found = both.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_match_block(stats.block_ids, k, len(stats.fields), bool(show)), MATCHED)
        rows = found.join(listed.select("id", newest, *show), "id")
        order = Window.partitionBy("query_id").orderBy("typos", "field", F.desc(newest), "id")
        top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return top.select("query_id", F.col("id").alias("article_id"), "typos", "field", "rank", *[marked(F.col(c), F.col("words")).alias(c) for c in show])


def marked(text: Column, words: Column) -> Column:
    """``text`` with each whole word of ``words`` (lower case) in marks, in either case."""
    one_of = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{M}\p{N}_])("), F.array_join(F.array_sort(words), "|"), F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
    return F.when(F.size(words) > 0, F.regexp_replace(text, one_of, F.lit("<mark>$1</mark>"))).otherwise(text)
