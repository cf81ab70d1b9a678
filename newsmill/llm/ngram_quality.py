"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of words (``WORDS``, order 3) in the registered query: lower-cased runs of letters
and digits, single other marks, and single characters of scripts that are written without
blanks. Its table grows with the corpus, so it stays sharded. ``CHARACTERS`` (order ``ORDER``)
is a model of small table for other uses. Counts of the highest order and continuation counts of the lower ones come
from all trusted texts; discounts from the counts of counts of each order. Probabilities are
joins of count tables that are sharded by n-gram, context and suffix, and make one table of
(n-gram, log10 probability, log10 backoff weight).

The registered query scores words by shards of the middle word (``word_shards``), from which only sums of texts come. Otherwise
a text's perplexity needs its n-grams' rows of that table: texts are cut into pages, each page asks for its distinct n-grams, the
requests are joined with the sharded table (each order's distinct n-grams once), and each page meets its answers; or a caller lets
a table of at most ``broadcast_grams`` rows (checked) go to every task. All ways give the same result.

One in ``HELD_OUT`` trusted texts (by a hash of the id) is not trained on: the model scores it
like any other text, so limits come from these. A document is kept if its perplexity is at
most ``margin`` times the ``quantile`` of the held-out texts of its language and length class
(short texts scatter more). A class of fewer than ``LEAST_HELD_OUT`` takes its language's
limit, then the limit over all.

Trusted ids reach the texts through a filter of 2 ** ``FILTER_BITS`` bits, whatever their
number, then an exact join; so texts that can't be trusted are not shuffled.

Defined cases: a null or empty text, or one without words, has no perplexity and is kept, for nothing speaks against
it; a null language is a language; without trusted texts nothing has a perplexity and all are
kept; rows that repeat an id are scored each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm import word_shards
from newsmill.llm.batches import slices
from newsmill.session import materialize, ship_package

ORDER = 5
#: Stands before a text's first characters; doesn't occur in texts (it is mapped away there).
PAD = 1
BROADCAST_GRAMS = 4_000_000
FILTER_BITS = 25
PAGE_BYTES = 1 << 20
HELD_OUT, LEAST_HELD_OUT = 10, 20
#: Bins of a factor e of perplexity, for counts of held-out texts.
BINS = 1000
LENGTHS = (200, 1000)  # length classes in characters: below, between, from

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's odd multiplier


# Thai, Lao, Burmese, Khmer, kana and Han are written without blanks.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+|[^\w\s]")


@dataclass(frozen=True)
class Unit:
    """What n-grams consist of: ``order`` tokens of ``width`` places in a ``kind`` value."""

    order: int
    kind: str
    width: int
    code: str

    def part(self, gram: Column | str, start: int, k: int) -> Column:
        """``k`` tokens of a gram from token ``start``, counted from 1."""
        return F.substring(gram, (start - 1) * self.width + 1, k * self.width)

    def has(self, k: int) -> Column:
        return F.char_length("gram") == k * self.width  # bytes of a binary value

    def pack(self, codes: np.ndarray) -> list:
        """Grams of rows of codes."""
        raw, step = codes.astype(self.code).tobytes(), codes.shape[1] * self.width
        raw = raw if self.kind == "binary" else raw.decode("utf-32-le", "surrogatepass")
        return [raw[i : i + step] for i in range(0, len(raw), step)]

    def unpack(self, grams: list) -> np.ndarray:
        """Codes of grams of one length."""
        raw = b"".join(grams) if self.kind == "binary" else "".join(grams).encode("utf-32-le", "surrogatepass")
        return np.frombuffer(raw, self.code).reshape(len(grams), -1)


CHARACTERS = Unit(ORDER, "string", 1, "<u4")
#: Words are known by 64-bit hashes; 100 million different ones have an equal pair with probability 3e-4.
WORDS = Unit(3, "binary", 8, "<u8")


def symbols(texts: list[str | None], unit: Unit = CHARACTERS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts (code points or hashes of words) end to end, each text after order - 1 pads, and the texts' borders."""
    if unit.kind == "string":
        pad = chr(PAD) * (unit.order - 1)
        clean = [pad + (t or "").replace(chr(PAD), " ") for t in texts]
        codes = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
        return codes, np.cumsum([0, *map(len, clean)])
    name: dict[str, int] = {}
    flat, ends = [], [0]
    for t in texts:
        flat += [PAD] * (unit.order - 1)
        words = WORD.findall((t or "").lower())
        for w in words:
            if w not in name:
                name[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        flat += [name[w] for w in words]
        ends.append(len(flat))
    return np.array(flat, np.uint64), np.array(ends)


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit name of the n-gram that ends at each place (the first order - 1 are meaningless)."""
    h = np.full(len(codes), order, np.uint64)
    for back in range(order - 1, -1, -1):
        c = codes.astype(np.uint64)
        if back:
            c[back:] = c[:-back].copy()
        h = (h ^ c) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def gram_names(grams: list, unit: Unit = CHARACTERS) -> np.ndarray:
    """The same names for grams of one length."""
    if not grams:
        return np.empty(0, np.uint64)
    codes = unit.unpack(grams)
    n = codes.shape[1]
    h = np.full(len(codes), n, np.uint64)
    for i in range(n):
        h = (h ^ codes[:, i].astype(np.uint64)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _scored_places(ends: np.ndarray, unit: Unit) -> np.ndarray:
    """Places of the texts' own tokens."""
    place = np.ones(int(ends[-1]), bool)
    for k in range(unit.order - 1):
        place[ends[:-1] + k] = False
    return np.flatnonzero(place)


def _distinct(codes: np.ndarray, places: np.ndarray, unit: Unit) -> tuple[list, np.ndarray]:
    """Distinct highest n-grams that end at ``places`` and their counts."""
    names, first, counts = np.unique(hashes(codes, unit.order)[places], return_index=True, return_counts=True)
    return unit.pack(codes[places[first][:, None] + np.arange(1 - unit.order, 1)]), counts


def trusted_texts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(id, lang, text) of the documents (id, lang, text) whose id is in ``trusted`` (id)."""
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = trusted.select(F.expr("pmod(xxhash64(id), 1 << %d) div 64" % FILTER_BITS).alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))").alias("b"))
    bits = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2 ** (FILTER_BITS - 6) rows
    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    table[bits["w"].to_numpy(np.int64)] = bits["b"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            at = b.column("spot").to_numpy()
            hit = shared.value[at // 64] >> (at % 64) & 1
            yield b.filter(pa.array(hit.astype(bool))).drop_columns(["spot"])

    maybe = docs.where("id IS NOT NULL").withColumn("spot", spot).mapInArrow(run, "id long, lang string, text string")
    return maybe.join(trusted.select("id").distinct(), "id", "left_semi")


def gram_counts(texts: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """(gram, n) of the highest order; tasks count before they shuffle."""

    def run(batches):
        for b in slices(batches, "text", 4 << 20):
            codes, ends = symbols(b.column("text").to_pylist(), unit)
            grams, counts = _distinct(codes, _scored_places(ends, unit), unit)
            yield pa.RecordBatch.from_arrays([pa.array(grams, unit.kind), pa.array(counts, pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(run, f"gram {unit.kind}, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams have the counts one to four; halves and more where these are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i / 2 for i in (1, 2, 3)]
    return tuple(min(max(d, 0.05), i) for i, d in zip((1, 2, 3), raw))


def _discounts(levels: list[DataFrame]) -> list[tuple[float, float, float]]:
    """The discounts of each order."""
    exact = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    all_levels = levels[0].select(F.lit(0).alias("k"), "n")
    for k, level in enumerate(levels[1:], 1):
        all_levels = all_levels.unionAll(level.select(F.lit(k).alias("k"), "n"))
    found = {r.k: r for r in all_levels.groupBy("k").agg(*exact).collect()}
    return [discounts_of([found[k][f"n{i}"] for i in (1, 2, 3, 4)] if k in found else [0] * 4) for k in range(len(levels))]


def train(texts: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """(gram, logp, backoff): log10 of the probability of the last token after the others, and of the weight that the gram as a context leaves to lower orders (null if it is none)."""
    levels = {unit.order: materialize(gram_counts(texts, unit), "grams")}
    for k in range(unit.order - 1, 0, -1):
        lower = levels[k + 1].groupBy(unit.part("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels[k] = materialize(lower, "grams")
    discounts = dict(zip(levels, _discounts(list(levels.values()))))
    alphabet = levels[1].count()
    below, grams_of, weights = None, [], []
    for k in range(1, unit.order + 1):
        one, two, more = discounts[k]
        n = F.col("n")
        off = F.when(n == 1, F.lit(one)).when(n == 2, F.lit(two)).otherwise(F.lit(more))
        left = F.lit(one) * F.count_if(n == 1) + F.lit(two) * F.count_if(n == 2) + F.lit(more) * F.count_if(n >= 3)
        grams = levels[k].withColumn("context", unit.part("gram", 1, k - 1))
        contexts = materialize(grams.groupBy("context").agg(F.sum("n").alias("total"), left.alias("left")), "contexts")
        joined = grams.join(contexts, "context").withColumn("own", F.greatest(n - off, F.lit(0.0)) / F.col("total"))
        rest = F.col("left") / F.col("total")
        if below is None:
            p = joined.select("gram", (F.col("own") + rest / F.lit(alphabet + 1.0)).alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            p = joined.withColumn("suffix", unit.part("gram", 2, k - 1)).join(lower, "suffix").select("gram", (F.col("own") + rest * F.col("lower")).alias("p"))
        below = materialize(p, "probabilities")
        grams_of.append(below.select("gram", F.log10("p").alias("logp")))
        weights.append(contexts.select(F.col("context").alias("gram"), F.log10(F.col("left") / F.col("total")).alias("backoff")))
    # The empty gram is what a token gets that the model has never seen.
    every = contexts.sparkSession.createDataFrame([(-math.log10(alphabet + 1.0),)], "logp double").select(F.lit("").cast(unit.kind).alias("gram"), "logp")
    for g in grams_of:
        every = every.unionByName(g)
    backoff = weights[0]
    for w in weights[1:]:
        backoff = backoff.unionByName(w)
    # Contexts of pads alone are no n-grams; they have a weight and no probability.
    return materialize(every.join(backoff, "gram", "full"), "model")


class Tables:
    """The model for one task: names, log10 probabilities and weights of each order, sorted by name."""

    def __init__(self, order: np.ndarray, names: np.ndarray, logp: np.ndarray, backoff: np.ndarray, unit: Unit):
        self.of, self.order = {}, unit.order
        for k in range(unit.order + 1):
            at = np.flatnonzero(order == k)
            at = at[np.argsort(names[at], kind="stable")]
            self.of[k] = names[at], logp[at], np.nan_to_num(backoff[at])

    def _find(self, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = self.of[k][0]
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        return at, known[at] == names

    def score(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 of the probability of the token at each place."""
        out, weight, todo = np.zeros(len(places)), np.zeros(len(places)), np.arange(len(places))
        for k in range(self.order, 0, -1):
            at, hit = self._find(k, hashes(codes, k)[places[todo]])
            out[todo[hit]] = weight[todo[hit]] + self.of[k][1][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            if k > 1:
                at, hit = self._find(k - 1, hashes(codes, k - 1)[places[todo] - 1])
                weight[todo] += np.where(hit, self.of[k - 1][2][at], 0)
            else:
                weight[todo] += self.of[0][2][0]
        out[todo] = weight[todo] + self.of[0][1][0]
        return out


def _totals(ends: np.ndarray, places: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log10 probability of each text."""
    text = np.searchsorted(ends, places, side="right") - 1
    return np.bincount(text, minlength=len(ends) - 1), np.bincount(text, scores, minlength=len(ends) - 1)


SCORED = "id long, lang string, n_chars long, n_tokens long, logp double"


def _scored(ids: pa.Array, langs: pa.Array, texts: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    chars = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
    return pa.RecordBatch.from_arrays([ids, langs, chars, pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["id", "lang", "n_chars", "n_tokens", "logp"])


def named(model: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """(k, name, logp, backoff): the model with names for grams."""

    def run(batches):
        for b in batches:
            grams = b.column("gram").to_pylist()
            k = np.array([len(g) // unit.width for g in grams], np.int32)
            names = np.zeros(len(grams), np.uint64)
            for n in np.unique(k):
                at = np.flatnonzero(k == n)
                names[at] = gram_names([grams[i] for i in at], unit) if n else 0
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(names.view(np.int64)), b.column("logp"), b.column("backoff")], ["k", "name", "logp", "backoff"])

    return model.select("gram", "logp", "backoff").mapInArrow(run, "k int, name long, logp double, backoff double")


def score_with_broadcast(docs: DataFrame, model: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """(id, lang, n_chars, n_tokens, logp) of the documents (id, lang, text); for a model of checked size."""
    t = named(model, unit).toArrow()
    columns = [t.column(c).to_numpy() for c in ("k", "name", "logp", "backoff")]
    shared = docs.sparkSession.sparkContext.broadcast(columns)

    def run(batches):
        order, names, logp, backoff = shared.value
        tables = Tables(order, names.view(np.uint64), logp, backoff, unit)
        for b in slices(batches, "text", PAGE_BYTES):
            codes, ends = symbols(b.column("text").to_pylist(), unit)
            places = _scored_places(ends, unit)
            yield _scored(b.column("id"), b.column("lang"), b.column("text"), *_totals(ends, places, tables.score(codes, places)))

    return docs.select("id", "lang", "text").mapInArrow(run, SCORED)


def answers(grams: DataFrame, model: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """(gram, logp) of different highest n-grams, by joins with the sharded model: each order's different n-grams
    meet their own rows, their contexts' weights and the answers of the order below."""
    asked = {unit.order: grams}
    for k in range(unit.order - 1, 0, -1):
        asked[k] = materialize(asked[k + 1].select(unit.part("gram", 2, k).alias("gram")).distinct(), "asked")
    unseen = F.lit(model.where(unit.has(0) & F.col("logp").isNotNull()).select("logp").first()[0])  # one number
    below = None
    for k in range(1, unit.order + 1):
        own = model.where(unit.has(k)).select("gram", F.col("logp").alias("own"))
        out = asked[k].join(own, "gram", "left").withColumn("context", unit.part("gram", 1, k - 1))
        context = model.where(unit.has(k - 1) & F.col("backoff").isNotNull()).select(F.col("gram").alias("context"), "backoff")
        out = out.join(context, "context", "left")
        if below is None:
            out = out.withColumn("lower", unseen)
        else:
            out = out.withColumn("suffix", unit.part("gram", 2, k - 1)).join(below.select(F.col("gram").alias("suffix"), F.col("logp").alias("lower")), "suffix")
        below = materialize(out.select("gram", F.coalesce("own", F.coalesce("backoff", F.lit(0.0)) + F.col("lower")).alias("logp")), "answers")
    return below


def score_with_joins(docs: DataFrame, model: DataFrame, unit: Unit = CHARACTERS) -> DataFrame:
    """The same for a model of any size: pages of texts meet the rows of their n-grams."""

    def cut(batches):
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", PAGE_BYTES):
            page += 1
            yield pa.RecordBatch.from_arrays([pa.array([page] * b.num_rows, pa.int64()), *b.columns], ["page", *b.schema.names])

    pages = materialize(docs.select("id", "lang", "text").mapInArrow(cut, "page long, id long, lang string, text string"), "pages")

    def ask(batches):
        for b in batches:
            pages_of = b.column("page")
            for page in pc.unique(pages_of):
                codes, ends = symbols(b.filter(pc.equal(pages_of, page)).column("text").to_pylist(), unit)
                grams, _ = _distinct(codes, _scored_places(ends, unit), unit)
                yield pa.RecordBatch.from_arrays([pa.array([page.as_py()] * len(grams), pa.int64()), pa.array(grams, unit.kind)], ["page", "gram"])

    # A page that lies in several batches may ask for an n-gram in each; equal answers do no harm.
    wanted = materialize(pages.select("page", "text").mapInArrow(ask, f"page long, gram {unit.kind}"), "requests")
    known = answers(materialize(wanted.select("gram").distinct(), "asked"), model, unit)
    given = wanted.join(known, "gram")

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        texts = own.column("text").to_pylist()
        codes, ends = symbols(texts, unit)
        places = _scored_places(ends, unit)
        names = gram_names(found.column("gram").to_pylist(), unit)
        order = np.argsort(names, kind="stable")
        at = order[np.searchsorted(names[order], hashes(codes, unit.order)[places])] if len(places) else np.empty(0, int)
        n, total = _totals(ends, places, found.column("logp").to_numpy()[at])
        return pa.Table.from_batches([_scored(*(own.column(c).combine_chunks() for c in ("id", "lang", "text")), n, total)])

    return pages.groupBy("page").cogroup(given.groupBy("page")).applyInArrow(score, SCORED)


def perplexities(docs: DataFrame, trusted: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, unit: Unit = CHARACTERS) -> DataFrame:
    """(id, lang, n_chars, perplexity) of every row of ``docs`` (id, lang, text); ``trusted`` has the ids (id) of trusted documents."""
    ship_package(docs.sparkSession)
    by_shards = unit is WORDS and not broadcast_grams
    if by_shards:
        model, numbers = word_shards.learn(trusted_texts(docs, trusted), word_shards.spelling(docs))
        size = numbers.alphabet if numbers else 0
    else:
        model = train(trusted_texts(docs, trusted), unit)
        size = model.count() - 2  # the empty gram and the context of pads
    if size <= 0:  # no n-gram at all
        scored = docs.select("id", "lang", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("double").alias("logp"))
    elif by_shards:
        scored = word_shards.score(docs, model, numbers)
    else:
        scored = (score_with_broadcast if size + 2 <= broadcast_grams else score_with_joins)(docs, model, unit)
    rate = F.when(F.col("n_tokens") > 0, F.pow(F.lit(10.0), -F.col("logp") / F.col("n_tokens")))
    return scored.select("id", "lang", "n_chars", rate.alias("perplexity"))


def _limits(binned: DataFrame, keys: list[str], quantile: float, margin: float, least: int, name: str) -> DataFrame:
    """(keys, name): ``margin`` times the upper edge of the bin that holds the quantile, by whole counts, so the same in every run; classes of fewer than ``least`` have none."""
    added = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    class_ = Window.partitionBy(*keys)  # a row a bin of a class
    ranked = added.withColumn("upto", F.sum("n").over(class_.orderBy("bin"))).withColumn("all", F.sum("n").over(class_))
    reached = ranked.where((F.col("all") >= least) & (F.col("upto") >= F.ceil(F.col("all") * F.lit(quantile))))
    return reached.groupBy(*keys).agg((F.exp((F.min("bin") + 1) / F.lit(float(BINS))) * margin).alias(name))


def classify(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = 0.99, margin: float = 1.25, broadcast_grams: int = BROADCAST_GRAMS, unit: Unit = CHARACTERS,
) -> DataFrame:
    """(id, lang, n_chars, perplexity, limit, kept) of every row; ``trusted`` has a column ``id``."""
    held_out = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(HELD_OUT)) == 0
    trusted = trusted.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    scored = materialize(perplexities(source, trusted.where(~held_out), broadcast_grams, unit), "perplexities")
    scored = scored.withColumn("l", F.coalesce("lang", F.lit(""))).withColumn("size", sum((F.col("n_chars") >= x).cast("int") for x in LENGTHS))
    good = scored.join(trusted.where(held_out), "id", "left_semi").where("perplexity IS NOT NULL")
    binned = good.withColumn("bin", F.floor(F.log("perplexity") * BINS)).groupBy("l", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    binned = materialize(binned, "held-out-bins")
    by_class = materialize(_limits(binned, ["l", "size"], quantile, margin, LEAST_HELD_OUT, "limit_class"), "limits")
    by_lang = materialize(_limits(binned, ["l"], quantile, margin, LEAST_HELD_OUT, "limit_lang"), "limits")
    over_all = F.lit(next((r[0] for r in _limits(binned, [], quantile, margin, 1, "limit").collect()), None)).cast("double")  # one number
    limits = scored.join(by_class, ["l", "size"], "left").join(by_lang, "l", "left")
    limit = F.coalesce("limit_class", "limit_lang", over_all)
    return limits.select("id", "lang", "n_chars", "perplexity", limit.alias("limit"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").alias("id"))
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted, broadcast_grams=0, unit=WORDS)
    return found.select(F.col("id").alias("doc_id"), "n_chars", "perplexity", "limit", "kept")
