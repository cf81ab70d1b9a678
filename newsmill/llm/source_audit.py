"""Source divergence audit: how far the words of a language's sources lie apart.

Terms are found in bytes: the texts of a batch lie end to end, a table of 256 entries tells which bytes belong to
a term (letters, and all bytes of other characters), and a term begins and ends where that changes or a text
does. XXH64 of the slices groups them; each group's slices are compared byte by byte with its first one, and
slices that differ (a collision) make groups of their own. Tasks add up what their batches count before
anything is shuffled.

A language keeps the terms that at least ``min_docs`` of its documents hold. Its kept terms are dealt to shards
by hash, as many as its rows need, so a language or source of any size is spread. A shard makes a sparse
matrix (a row a source, a column a term) of shares p = 1 + floor(10^9 (count + 5) / (N + 5 V)), all in integers.
For a source and all later ones, its row is laid out densely once; the other rows' entries are compared with it and
summed a row at a time with ``reduceat``, and what a row doesn't hold comes from sorted sums of the first
one. So a shard's work is its entries for each source, and its rows are sums a pair, or the
``most_terms`` greatest excesses a source: sums are added up and lists merged over shards.

Defined cases: null text, lang and source are empty strings; rows that repeat an id are documents of their own;
a group without terms has all shares equal; a language without kept terms has pairs of value 0 and no
term rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.batches import joined_bytes, slices
from newsmill.session import drop_shared, materialize, ship_package

MIN_DOCS, MOST_TERMS = 30, 50
#: Entries (a term of a source) of a shard on average: as many as its pairs of sources, within these bounds. Sources whose pairs one task compares with all later ones.
LEAST_ENTRIES, MOST_ENTRIES, BLOCK_SOURCES = 1 << 14, 1 << 20, 256
#: Bytes of text that are cut into terms at a time, and counted rows that a task holds before it hands them on.
BATCH_BYTES, HELD_ROWS = 2 << 20, 1 << 19

IN_TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
LOWERED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
KEYS = ["lang", "source", "term"]


def term_slices(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term begins and ends in ``raw``; ``ends`` are the texts' borders, from zero: no term crosses one."""
    inside = IN_TERM[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[ends] = True
    before, after = np.r_[False, inside[:-1]], np.r_[inside[1:], False]
    return np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1


def group_slices(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): slices of a group hold the same bytes, those of different groups don't.

    Terms hold no zero byte, so the eight bytes of a short one are a number of its own: of its copies one is hashed.
    """
    sizes = stops - starts
    short, long = np.flatnonzero(sizes <= 8), np.flatnonzero(sizes > 8)
    eight = np.r_[raw, np.zeros(8, np.uint8)][starts[short, None] + np.arange(8)]
    eight[np.arange(8) >= sizes[short, None]] = 0
    names, firsts, same = np.unique(eight.view("<u8")[:, 0], return_index=True, return_inverse=True)
    one = np.r_[short[firsts], long]
    of = np.empty(len(starts), np.int64)
    of[short], of[long] = same, len(names) + np.arange(len(long))
    group, firsts = _hashed_groups(raw, starts[one], stops[one], digest)
    return group[of], one[firsts]


def _hashed_groups(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, digest) -> tuple[np.ndarray, np.ndarray]:
    """The same by hashes, whose groups are compared byte by byte."""
    data, n = raw.tobytes(), len(starts)
    h = np.fromiter((digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)
    _, firsts, group = np.unique(h, return_index=True, return_inverse=True)
    sizes = stops - starts
    model = firsts[group]
    wrong = sizes != sizes[model]
    # Byte by byte: the places of all slices' bytes, and those of their groups' first slices.
    same = np.flatnonzero(~wrong)
    lengths = sizes[same]
    offsets = np.r_[0, np.cumsum(lengths)]
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    differs = raw[np.repeat(starts[same], lengths) + within] != raw[np.repeat(starts[model[same]], lengths) + within]
    if len(same):
        wrong[same] = np.logical_or.reduceat(differs, offsets[:-1])
    found: dict[bytes, int] = {}
    extra = []
    for i in np.flatnonzero(wrong).tolist():  # collisions
        key = data[starts[i] : stops[i]]
        if key not in found:
            found[key] = len(firsts) + len(extra)
            extra.append(i)
        group[i] = found[key]
    return group, np.r_[firsts, np.array(extra, np.int64)]


def count_terms(batch: pa.RecordBatch, digest=xxhash.xxh64_intdigest) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (text, lang, source); a row with a null term for each lang and source."""
    raw, ends = joined_bytes(batch.column("text"))
    raw = LOWERED[raw]
    starts, stops = term_slices(raw, ends)
    group, firsts = group_slices(raw, starts, stops, digest)
    kinds: dict[tuple[str, str], int] = {}
    named = zip(*(batch.column(c).to_pylist() for c in KEYS[:2]))
    kind = np.array([kinds.setdefault((lang or "", source or ""), len(kinds)) for lang, source in named], np.int64)
    doc = np.searchsorted(ends, starts, "right") - 1
    # Each term of a document once, with how often it is there.
    held, times = np.unique(group * batch.num_rows + doc, return_counts=True)
    of, doc = np.divmod(held, batch.num_rows) if batch.num_rows else (held, held)
    keys, where = np.unique(of * max(1, len(kinds)) + kind[doc], return_inverse=True)
    of, kind = np.divmod(keys, max(1, len(kinds)))
    n = np.bincount(where, times, len(keys)).astype(np.int64)
    docs = np.bincount(where, minlength=len(keys))
    data = raw.tobytes()
    terms = pa.array([data[starts[i] : stops[i]] for i in firsts.tolist()], pa.binary()).cast(pa.string())
    langs, sources = (pa.array([x[c] for x in kinds], pa.string()) for c in (0, 1))
    here = pa.table([langs.take(pa.array(kind)), sources.take(pa.array(kind)), terms.take(pa.array(of)), pa.array(n), pa.array(docs, pa.int64())], [*KEYS, "n", "docs"])
    zero = pa.array([0] * len(kinds), pa.int64())
    return pa.concat_tables([here, pa.table([langs, sources, pa.nulls(len(kinds), pa.string()), zero, zero], here.column_names)])


def _added(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select([*KEYS, "n_sum", "docs_sum"]).rename_columns([*KEYS, "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; the null term stands for the group itself."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        held, rows = [], 0
        for b in slices(batches, "text", BATCH_BYTES):
            held.append(count_terms(b))
            rows += held[-1].num_rows
            if rows >= HELD_ROWS:
                held = [_added(held)]
                rows = held[0].num_rows
                if rows >= HELD_ROWS // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, rows = [], 0
        if held:
            yield from _added(held).to_batches(max_chunksize=1 << 16)

    named = docs.select(*(F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    rows = named.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / whole), exactly: three digits of the quotient in base 1000."""
    rest, share = count + 5, np.zeros(len(count), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        share = share * 1000 + digit
    return share + 1


def pair_sums(rows: np.ndarray, columns: np.ndarray, p: np.ndarray, p0: np.ndarray, width: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row from ``first`` to before ``last``: its sums of absolute differences to all later rows.

    The matrix has ``width`` columns; entries are sorted by row, ``p0`` is what a row has elsewhere.
    """
    ends = np.searchsorted(rows, np.arange(len(p0) + 1))
    for a in range(first, min(last, len(p0) - 1)):
        own, at = p[ends[a] : ends[a + 1]], columns[ends[a] : ends[a + 1]]
        dense = np.full(width, p0[a])
        dense[at] = own
        # All columns as though the later rows had no entry: sums of |own - p0| from sorted own shares.
        ranked = np.sort(own)
        sums = np.r_[0, np.cumsum(ranked)]
        later = p0[a + 1 :]
        below = np.searchsorted(ranked, later)
        apart = later * below - sums[below] + sums[-1] - sums[below] - later * (len(own) - below)
        apart += (width - len(own)) * np.abs(p0[a] - later)
        # The entries of the later rows in the place of that.
        there = dense[columns[ends[a + 1] :]]
        more = np.abs(there - p[ends[a + 1] :]) - np.abs(there - p0[rows[ends[a + 1] :]])
        filled = np.flatnonzero(ends[a + 1 : -1] < ends[a + 2 :])
        if len(filled):
            apart[filled] += np.add.reduceat(more, ends[a + 1 + filled] - ends[a + 1])
        yield a, apart


RESULT = "lang string, source string, part string, item string, value long"


def divergences(most_terms: int):
    """A shard's sums and greatest excesses, from its entries and the groups of its language."""

    def run(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, block = (k.as_py() for k in key)
        names = groups.column("source").combine_chunks().cast(pa.binary())
        order = pc.sort_indices(names)
        groups, names = groups.take(order), names.take(order)
        n, n_lang, v = (groups.column(c).to_numpy() for c in ("n_group", "n_lang", "v"))
        out = {c: [] for c in ("source", "part", "item", "value")}

        def add(source, part: str, item, value: np.ndarray) -> None:
            for c, x in (("source", names.take(pa.array(source))), ("part", pa.array([part] * len(value), pa.string())), ("item", item), ("value", pa.array(value, pa.int64()))):
                out[c].append(x)

        if len(names):
            whole = n + 5 * v
            # Without kept terms there are no columns either, and any divisor will do.
            p0 = shares(np.zeros(len(names), np.int64), np.maximum(whole, 5))
            coded = entries.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
            columns, terms = coded.indices.to_numpy(), coded.dictionary
            rows = pc.index_in(entries.column("source").combine_chunks().cast(pa.binary()), names).to_numpy().astype(np.int64)
            p = shares(entries.column("n").to_numpy(), whole[rows])
            if block == 0:
                excess = p - shares(entries.column("total").to_numpy(), n_lang[rows] + 5 * v[rows])
                rank = np.empty(len(terms), np.int64)
                rank[pc.sort_indices(terms).to_numpy()] = np.arange(len(terms))
                at = np.flatnonzero(excess > 0)
                at = at[np.lexsort((rank[columns[at]], -excess[at], rows[at]))]
                at = at[np.arange(len(at)) - np.searchsorted(rows[at], rows[at]) < most_terms]
                add(rows[at], "term", terms.take(pa.array(columns[at])), excess[at])
            by_row = np.argsort(rows, kind="stable")
            first = block * BLOCK_SOURCES
            for a, value in pair_sums(rows[by_row], columns[by_row], p[by_row], p0, len(terms), first, first + BLOCK_SOURCES):
                add(np.full(len(value), a), "pair", names.slice(a + 1), value)
        arrays = [pa.chunked_array(x, pa.binary() if c in ("source", "item") else None) if x else pa.chunked_array([], pa.binary()) for c, x in out.items()]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        cast = [x.cast(k) if len(x) else pa.chunked_array([], k) for x, k in zip(arrays, kinds)]
        return pa.table([pa.array([lang] * len(cast[0]), pa.string()), *cast], ["lang", *out])

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, most_terms: int = MOST_TERMS, shard_entries: int | None = None, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources, and the terms that a source has in excess."""
    counts = materialize(term_counts(docs, **columns), "term-counts")
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept-terms")
    entries = materialize(counts.where("term IS NOT NULL").join(kept, ["lang", "term"]).select(*KEYS, "n", "total"), "kept-entries")

    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("entries"))
    groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["n_group", "entries"])
    groups = materialize(groups, "groups")
    drop_shared(counts)
    langs = groups.groupBy("lang").agg(F.sum("n_group").alias("n_lang"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").na.fill(0, ["v"])
    size = F.lit(shard_entries) if shard_entries else F.least(F.greatest(F.lit(LEAST_ENTRIES), F.col("sources") * F.col("sources")), F.lit(MOST_ENTRIES))
    langs = materialize(langs.select("lang", "n_lang", "v", F.ceil(F.greatest(F.col("entries"), F.lit(1)) / size).alias("shards"), F.ceil(F.col("sources") / BLOCK_SOURCES).alias("blocks")), "languages")

    block = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block")
    shard = F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard")
    dealt = entries.join(langs.select("lang", "shards", "blocks"), "lang")
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), block, "source", "term", "n", "total")
    beside = groups.select("lang", "source", "n_group").join(langs, "lang").select("lang", shard, "blocks", "source", "n_group", "n_lang", "v")
    beside = beside.select("lang", "shard", block, "source", "n_group", "n_lang", "v")
    key = ["lang", "shard", "block"]
    found = materialize(dealt.groupBy(*key).cogroup(beside.groupBy(*key)).applyInArrow(divergences(most_terms), RESULT), "divergences")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rows = found.where("part = 'term'").unionByName(pairs.withColumn("part", F.lit("pair")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= most_terms))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(terms) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang
), g AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), w AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM w WHERE part = 'pair' OR rank <= 50
"""
