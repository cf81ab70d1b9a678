"""Quality rules: fixed limits, and robust outliers within a language and source.

A text's statistics become a vector of logarithms (:data:`FEATURES`). For each language and
source a minimum-covariance-determinant estimate finds the centre and covariance of the
tightest part of the vectors: from two starts it takes concentration steps, each of which keeps
the ``inner`` share of rows with the smallest Mahalanobis distance and takes their mean and
covariance, until the determinant falls no more; the smaller of the two determinants wins.
A row whose squared distance exceeds the chi-squared
quantile of ``keep_probability`` is rejected. Every feature has a least deviation: in these
units no direction's variance is taken below one, so a
statistic that hardly varies in clean text (repeated lines, symbols) rejects gross cases only.

Shares and quartiles come from whole counts of narrow bins (1 / ``BINS`` of a least deviation for
features, a relative 1 / ``FINE`` for distances), so results don't depend on the order of rows or tasks.
A step is an aggregate of counts, sums and products per group; a group, however large, only
meets as one partial row a task. Distances are Column arithmetic. A model has one row a group.

Defined cases: a null text has no words; a text that fails the fixed limits takes no part in
the estimates and gets no distance; null languages and sources are groups like others; a
language and source of fewer than ``least_rows`` such rows joins its language's group of
those, then one group of the rest; a group of equal rows has only the least deviations; an
empty table gives an empty table; a carried column named like a result is left out; rows are independent otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.session import materialize, ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS, STOPS = "#*$%&|<>", ".,;:!?¡¿…"

#: Statistics of a text, as columns.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_stops", "n_digits", "n_lines")
#: feature: (expression over the statistics, least deviation)
FEATURES = {
    "length": ("ln(n_words)", 0.7),
    "word_length": ("ln(word_chars / n_words)", 0.1),
    "symbols": ("ln(0.05 + n_symbols / n_words)", 0.3),
    "repeated_lines": ("ln(0.05 + n_dup_lines / n_lines)", 0.5),
    "repeated_words": ("ln(0.1 + n_repeat_words / n_words)", 0.45),
    "capitals": ("ln(0.05 + n_upper / word_chars)", 0.35),
    "stops": ("ln(0.05 + n_stops / n_words)", 0.35),
    "digits": ("ln(0.05 + n_digits / word_chars)", 0.5),
    "variety": ("ln(n_distinct_words / n_words)", 0.12),
}
D = len(FEATURES)
FLOORS = np.array([x[1] for x in FEATURES.values()])
X = [f"x{i}" for i in range(D)]
BINS, FINE = 64, 512
#: Values of the second start are cut at so many deviations; a step that gains less ends a search.
WRAP, LEAST_GAIN = 1.5, 1e-3


def _classes() -> np.ndarray:
    """The class of each character of the basic plane: capital, digit, stop, symbol or none."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        table[c] = 1 if ch.isupper() else 2 if ch.isdigit() else 0
    table[[ord(c) for c in STOPS]] = 3
    table[[ord(c) for c in SYMBOLS]] = 4
    return table


_table: list = []


def text_statistics(text: str | None) -> tuple[int, ...]:
    if not _table:
        _table.append(_classes())
    text = text or ""
    w = WORD.findall(text)
    repeated = 0
    if len(w) > 3:
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            covered = bytearray(len(w))
            for i, x in enumerate(windows):
                if seen[x] > 1:
                    covered[i] = covered[i + 1] = covered[i + 2] = 1
            repeated = sum(covered)
    lines = text.split("\n")
    filled = [x for x in lines if WORD.search(x)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(_table[0][np.where(codes < 1 << 16, codes, 0)], minlength=5) if len(codes) else np.zeros(5, int)
    return (
        len(w), sum(map(len, w)), int(kinds[4]), len(filled) - len(set(filled)), repeated,
        len(set(w)), int(kinds[1]), int(kinds[3]), int(kinds[2]), len(lines),
    )


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct column ``stats`` (a column of that name is replaced)."""
    ship_package(docs.sparkSession)
    kind = pa.struct([(s, pa.int64()) for s in STATS])

    @F.arrow_udf("struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">")
    def count(texts: pa.Array) -> pa.Array:
        rows = [text_statistics(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(STATS), fields=list(kind))

    return docs.withColumn("stats", count(F.col(text_col)))


def chi_squared_quantile(p: float, d: int) -> float:
    """By Wilson and Hilferty's cube."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def chi_squared_cdf(x: float, d: int) -> float:
    return NormalDist().cdf(((x / d) ** (1 / 3) - 1 + 2 / (9 * d)) / (2 / (9 * d)) ** 0.5)


def _distance(centre: str = "m", whiten: str = "w") -> Column:
    """The squared length of the whitened difference; ``whiten`` holds a lower triangle by rows."""
    y = [F.col(X[i]) - F.col(centre)[i] for i in range(D)]
    rows = [reduce(Column.__add__, [F.col(whiten)[i * (i + 1) // 2 + j] * y[j] for j in range(i + 1)]) for i in range(D)]
    return reduce(Column.__add__, [r * r for r in rows])


MODEL = "g string, start int, m array<double>, w array<double>, logdet double"


def _at(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """``keys`` and, for each of ``shares``, the bin of the row that has this share of the rows up to it.

    ``counts`` has keys, bin, n: whole counts, so the answer is exact up to the bins' width and the
    same in every run. A task holds the bins of a key, whose number doesn't follow the rows'.
    """
    w = Window.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), F.col("bin"))).alias(name) for name, p in shares.items()])


def _moments(rows: DataFrame, keys: list[str], x: list[Column]) -> DataFrame:
    """Count, sums and products of the columns ``x``."""
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _covariance(r: dict) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([r[f"s{i}"] for i in range(D)]) / r["n"]
    second = np.zeros((D, D))
    for i in range(D):
        for j in range(i + 1):
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
    return mean, second - np.outer(mean, mean)


def whitened(cov: np.ndarray) -> tuple[list[float], float]:
    """The lower triangle that whitens ``cov``, and its log determinant. In units of the least deviations no direction has a variance below one."""
    values, vectors = np.linalg.eigh(cov / np.outer(FLOORS, FLOORS))
    values = np.maximum(values, 1.0)
    floored = (vectors * values) @ vectors.T * np.outer(FLOORS, FLOORS)
    lower = np.linalg.inv(np.linalg.cholesky((floored + floored.T) / 2))
    return [lower[i, j] for i in range(D) for j in range(i + 1)], float(np.log(values).sum() + 2 * np.log(FLOORS).sum())


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts a group around the medians: quartile ranges as independent deviations, and with the correlations of values that are cut at ``WRAP`` of these."""
    binned = F.posexplode(F.array(*[F.floor(F.col(x) / F.lit(float(f)) * BINS) for x, f in zip(X, FLOORS)])).alias("i", "bin")
    counts = rows.select("g", binned).groupBy("g", "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    q = _at(counts, ["g", "i"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    by_feature = F.transform(F.sort_array(F.collect_list(F.struct("i", "low", "mid", "high"))), lambda s: F.struct(s["mid"].alias("mid"), (s["high"] - s["low"]).alias("range")))
    unit = [F.lit(float(f) / BINS) for f in FLOORS]
    q = q.groupBy("g").agg(by_feature.alias("q"))
    middle = F.array(*[(F.col("q")[i]["mid"] + 0.5) * unit[i] for i in range(D)])
    scale = F.array(*[F.greatest(F.col("q")[i]["range"] * unit[i] / 1.349, F.lit(float(f))) for i, f in enumerate(FLOORS)])
    q = materialize(q.select("g", middle.alias("m"), scale.alias("scale")), "quartiles")
    cut = [F.greatest(F.lit(-WRAP), F.least(F.lit(WRAP), (F.col(X[i]) - F.col("m")[i]) / F.col("scale")[i])) for i in range(D)]
    moments = _moments(rows.join(q, "g"), ["g"], cut).join(q, "g")

    def solve(parts):
        for part in parts:
            models = []
            for r in part.to_dict("records"):
                _, cov = _covariance(r)
                scale = np.asarray(r["scale"])
                for k, c in enumerate((np.diag(scale**2), cov * np.outer(scale, scale))):
                    models.append((r["g"], k, list(r["m"]), whitened(c)[0], float("inf")))
            yield pd.DataFrame(models, columns=["g", "start", "m", "w", "logdet"])

    return materialize(moments.mapInPandas(solve, MODEL), "models")


def _concentrate(rows: DataFrame, model: DataFrame, inner: float) -> DataFrame:
    """The mean and covariance of the ``inner`` share of each group that lies nearest by each of its models."""
    near = rows.join(model, "g").select("g", "start", *X, F.floor(F.log2(_distance() + 1e-9) * FINE).alias("bin"))
    counts = near.groupBy("g", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    limit = _at(counts, ["g", "start"], {"limit": inner})
    kept = near.join(limit, ["g", "start"]).where("bin <= limit")
    spread = inner / chi_squared_cdf(chi_squared_quantile(inner, D), D + 2)

    def solve(parts):
        for part in parts:
            models = []
            for r in part.to_dict("records"):
                mean, cov = _covariance(r)
                models.append((r["g"], r["start"], mean.tolist(), *whitened(spread * cov)))
            yield pd.DataFrame(models, columns=["g", "start", "m", "w", "logdet"])

    return materialize(_moments(kept, ["g", "start"], [F.col(x) for x in X]).mapInPandas(solve, MODEL), "models")


def estimate(rows: DataFrame, inner: float = 0.75) -> DataFrame:
    """(g, m, w) of rows (g, x0, x1, …): the least determinant found from the starts.

    Only models that a step has improved are stepped again. A step lowers a determinant or ends its
    search, so the rounds end; each is one written table with a row a group and start.
    """
    moving, done = _starts(rows), None
    while True:
        after = _concentrate(rows, moving, inner)
        before = moving.select("g", "start", F.col("logdet").alias("old"))
        pairs = after.join(before, ["g", "start"])
        better = materialize(pairs.where(F.col("logdet") < F.col("old") - LEAST_GAIN).drop("old"), "models")
        settled = pairs.where(F.col("logdet") >= F.col("old") - LEAST_GAIN).drop("old")
        done = settled if done is None else done.unionByName(settled)
        moving = better
        if not moving.limit(1).count():
            break
    best = done.groupBy("g").agg(F.min_by(F.struct("m", "w"), F.struct("logdet", "start")).alias("b"))
    return materialize(best.select("g", "b.m", "b.w"), "models")


def _grouped(rows: DataFrame, lang_col: str, source_col: str, least_rows: int) -> DataFrame:
    """Adds g: the language and source, the language, or the rest."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    rows = rows.withColumn("_l", lang).withColumn("_ls", F.concat_ws("\x01", lang, source))
    fit = rows.where("fit")
    own = materialize(fit.groupBy("_ls").agg(F.first("_l").alias("_l"), F.count(F.lit(1)).alias("_n")), "group-sizes")
    rest = materialize(own.where(F.col("_n") < least_rows).groupBy("_l").agg(F.sum("_n").alias("_nl")), "language-sizes")
    rows = rows.join(own.select("_ls", "_n"), "_ls", "left").join(rest, "_l", "left")
    g = F.when(F.col("_n") >= least_rows, F.col("_ls")).when(F.col("_nl") >= least_rows, F.concat(F.col("_l"), F.lit("\x02"))).otherwise(F.lit("\x03"))
    return rows.withColumn("g", g).drop("_l", "_ls", "_n", "_nl")


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ("doc_id",),
    inner: float = 0.75, keep_probability: float = 0.99999, least_rows: int = 50,
) -> DataFrame:
    """``carry`` columns, the statistics, base_failed, distance (null without one) and kept, a row a document."""
    source = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    flat = statistics(source, "_text").select(*[f"_c{i}" for i in range(len(carry))], "_lang", "_source", "stats.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    flat = flat.withColumn("fit", ~failed)
    vector = [F.when(F.col("fit"), F.expr(e)).alias(x) for x, (e, _) in zip(X, FEATURES.values())]
    flat = materialize(flat.select("*", *vector), "statistics")
    rows = materialize(_grouped(flat, "_lang", "_source", least_rows), "grouped-statistics")
    fit = rows.where("fit").select("g", *X)
    model = estimate(fit, inner)
    limit = chi_squared_quantile(keep_probability, D)
    judged = rows.join(model, "g", "left").withColumn("distance", F.when(F.col("fit"), _distance()))
    kept = F.col("fit") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    carried = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c not in (*STATS, "base_failed", "distance", "kept")]
    return judged.select(*carried, *STATS, (~F.col("fit")).alias("base_failed"), "distance", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
