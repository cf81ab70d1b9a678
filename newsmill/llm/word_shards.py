"""Perplexity under the model of words (``ngram_quality.WORDS``), with one exchange of the texts' n-grams.

The log probability of a text under an interpolated model is a sum over its n-grams: every token adds its own
unigram value, every context its backoff weight, every n-gram that the model has a correction, and n-grams that it
hasn't add nothing. All that a place adds follows from the three words around it: of (u, v, w), the unigram of v, the weights
of the contexts v and (u, v), the corrections of (v, w) and (u, v, w). So counts of trusted texts and n-grams of all texts are both
sharded by the middle word v; a shard makes its part of the model from its own counts, adds up what its n-grams give
each text, and only sums of texts leave it. No n-gram asks for an answer.

A word is a 64-bit hash. What travels is a block of a page's different n-grams of a shard in sorted columns of
short codes: the commonest ``TABLE`` words by their rank, others by their place in the block's list of hashes. The table is only a
spelling. Words that no trusted text has (by a filter of ``FILTER_BITS`` bits) need no spelling; what
the filter lets through is found by its hash. A word with more than ``SPLIT`` places has several shards by the word that follows;
they share the totals of its contexts. Sums are whole numbers of 2 ** -``FRACTION``, so they don't depend on any order.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsmill.llm.batches import slices
from newsmill.session import drop_shared, materialize, release_shuffles

TABLE = 1 << 18
FILTER_BITS = 25
PAGE_BYTES = 2 << 20
#: Places of words in a shard, shards at least, and places of one word in a shard.
SHARD_PLACES, LEAST_SHARDS, SPLIT = 3_000_000, 24, 2_000_000
#: One text in so many (by a hash) is looked at for the spelling and the number of shards, as a range partitioner looks
#: for its borders. No result depends on it; all texts are counted and scored.
LAYOUT_TEXTS = 8
#: Texts are scored in so many rounds, each text in one, so that a round's blocks are gone before the next.
ROUNDS = 2
FRACTION = 28
END, PAD, UNKNOWN = 0, 1, 2  # names that no word has; the table's first three

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PARTS = "kind int, shard int, v long, u long, total long, n1 long, n2 long, n3 long, triples binary"
MODEL, CONTEXT, ENDING, COUNTS = range(4)


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of parts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for x in parts:
        h = (h ^ x) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all different words (the three marks first), and the texts as places in them, each as PAD, words, END."""
    from newsmill.llm.ngram_quality import WORD

    found = [WORD.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(x) for x in found], np.int64)
    words = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
    flat = np.full(len(words) + 2 * len(found), END, np.int64)
    flat[np.arange(len(words)) + 2 * np.repeat(np.arange(len(found)), sizes) + 1] = words.indices.to_numpy() + 3
    flat[np.cumsum(sizes + 2) - sizes - 2] = PAD
    names = [END, PAD, UNKNOWN, *(xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist())]
    return np.array(names, np.uint64), flat


def _triples(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) around each place but END, and the text of each; texts without words have none."""
    at = np.flatnonzero((flat[:-1] != END) & ((flat[:-1] != PAD) | (flat[1:] != END)))
    v, w = flat[at], flat[at + 1]
    u = np.where(v == PAD, PAD, flat[at - 1])
    return u, v, w, (np.cumsum(flat == PAD) - 1)[at]


@dataclass
class Spelling:
    """The table's words by rank, and in how many shards each has its places."""

    words: np.ndarray
    parts: np.ndarray
    shards: int

    def __post_init__(self):
        self.order = np.argsort(self.words)
        self.sorted = self.words[self.order]

    def codes(self, names: np.ndarray) -> np.ndarray:
        """Ranks of words, -1 for others."""
        at = np.minimum(np.searchsorted(self.sorted, names), len(self.sorted) - 1)
        return np.where(self.sorted[at] == names, self.order[at], -1)

    def spell(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of words, and the names of those beyond the table."""
        codes = self.codes(names)
        rare, place = np.unique(names[codes < 0], return_inverse=True)
        codes[codes < 0] = len(self.words) + place
        return codes, rare

    def parts_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where((codes >= 0) & (codes < len(self.words)), self.parts[np.clip(codes, 0, len(self.words) - 1)], 1).astype(np.uint64)

    def place(self, v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return ((mixed(v, part) >> np.uint64(33)) % np.uint64(self.shards)).astype(np.int64)

    def shard(self, names: np.ndarray, codes: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Shards of middle words and those that follow, as places in names and codes."""
        parts = self.parts_of(codes)
        shard = self.place(names, np.zeros(len(names), np.uint64))[v]
        many = np.flatnonzero(parts[v] > 1)
        shard[many] = self.place(names[v[many]], (mixed(names) >> np.uint64(33))[w[many]] % parts[v[many]])
        return shard


ZSTD = pa.Codec("zstd", compression_level=1)


def _squeezed(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes; planes of zeros take no place."""
    out = []
    for plane in x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T:
        z = ZSTD.compress(np.ascontiguousarray(plane), asbytes=True) if plane.any() else b""
        out.append(struct.pack("<I", len(z)) + z)
    return b"".join(out)


def _expanded(raw: memoryview, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    out = np.zeros((np.dtype(kind).itemsize, n), np.uint8)
    for plane in out:
        (size,) = struct.unpack_from("<I", raw, at)
        at += 4
        if size:
            plane[:] = np.frombuffer(pa.decompress(raw[at : at + size], n, codec="zstd"), np.uint8)
        at += size
    return np.ascontiguousarray(out.T).reshape(-1).view(kind), at


def packed(u: np.ndarray, v: np.ndarray, w: np.ndarray, rare: np.ndarray, table: int, *more: np.ndarray) -> bytes:
    """A block of different triples of codes, sorted by v, w, u; ``more`` are further columns of any length."""
    used = np.unique(np.concatenate([x[x >= table] for x in (u, v, w)]))
    u, v, w = (np.where(x >= table, table + np.searchsorted(used, x), x) if len(used) else x for x in (u, v, w))
    new_v = np.diff(v, prepend=-1) != 0
    new_w = new_v | (np.diff(w, prepend=-1) != 0)
    # Renumbering keeps the order, so steps within equal v and equal (v, w) aren't negative.
    columns = [np.diff(v, prepend=0), np.where(new_v, w, np.diff(w, prepend=0)), np.where(new_w, u, np.diff(u, prepend=0))]
    names = rare[used - table].tobytes()
    return b"".join([struct.pack("<III", len(v), len(used), table), names, *(_squeezed(c.astype("<u4")) for c in columns), *(struct.pack("<I", len(m)) + _squeezed(m.astype("<i8")) for m in more)])


def _from_starts(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Running sums that begin anew where ``new``."""
    total = np.cumsum(steps)
    first = np.flatnonzero(new)
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(steps))))


def unpacked(block: bytes) -> tuple[np.ndarray, ...]:
    """The names beyond the table, u, v, w as codes, then the further columns."""
    raw = memoryview(block)
    n, m, _ = struct.unpack_from("<III", raw, 0)
    names, at = np.frombuffer(raw[12 : 12 + 8 * m], "<u8"), 12 + 8 * m
    steps = []
    for _ in range(3):
        x, at = _expanded(raw, at, n, "<u4")
        steps.append(x.astype(np.int64))
    v = np.cumsum(steps[0])
    new_v = np.diff(v, prepend=-1) != 0
    w = _from_starts(steps[1], new_v)
    u = _from_starts(steps[2], new_v | (np.diff(w, prepend=-1) != 0))
    out = [names, u, v, w]
    while at < len(raw):
        (k,) = struct.unpack_from("<I", raw, at)
        x, at = _expanded(raw, at + 4, k, "<i8")
        out.append(x)
    return tuple(out)


def _looked_up(codes: np.ndarray, words: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """What ``words`` has for codes of the table, and ``rare`` for those beyond."""
    out = words[np.minimum(codes, len(words) - 1)]
    far = codes >= len(words)
    out[far] = rare[codes[far] - len(words)]
    return out


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from those before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _sorted_places(u: np.ndarray, v: np.ndarray, w: np.ndarray, shard: np.ndarray, codes: int) -> np.ndarray:
    """The order by shard, v, w, u that keeps equal ones in place."""
    if codes <= 1 << 21:
        order = np.argsort(v << 42 | w << 21 | u, kind="stable")
    else:
        order = np.lexsort((u, w, v))
    shard = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard
    return order[np.argsort(shard[order], kind="stable")]


def _blocks(u, v, w, text, rare, shard, table, with_texts: bool):
    """(shard, block) of places: different triples with their counts, or with texts and counts in each."""
    order = _sorted_places(u, v, w, shard, table + len(rare))
    u, v, w, text, shard = u[order], v[order], w[order], text[order], shard[order]
    step = lambda *xs: np.append(True, np.any([np.diff(x) != 0 for x in xs], axis=0)) if len(u) else np.empty(0, bool)
    triple = step(u, v, w, shard)
    entry = triple | step(text) if with_texts else triple
    entries = np.flatnonzero(entry)
    counts = np.diff(np.append(entries, len(u)))
    starts = np.flatnonzero(triple)  # places
    of = np.searchsorted(entries, starts)  # entries
    per = np.diff(np.append(of, len(entries)))
    cuts = np.flatnonzero(np.append(True, np.diff(shard[starts]) != 0)) if len(starts) else np.empty(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(starts))):
        at, e = starts[a:b], slice(of[a], of[b] if b < len(of) else len(entries))
        more = [counts[e]]
        if with_texts:
            docs = text[entries[e]]
            first = np.zeros(len(docs), bool)
            first[of[a:b] - of[a]] = True
            more = [per[a:b] - 1, np.where(first, docs, np.diff(docs, prepend=0)), counts[e] - 1]
        yield int(shard[starts[a]]), packed(u[at], v[at], w[at], rare, table, *more)


def word_counts(docs: DataFrame) -> DataFrame:
    """(v, n): places of each word, the start of a text among them."""

    def run(batches):
        for b in slices(batches, "text", PAGE_BYTES):
            names, flat = words_of(b.column("text").to_pylist())
            n = np.bincount(flat, minlength=len(names))
            n[END] = 0
            there = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[there].view(np.int64)), pa.array(n[there], pa.int64())], ["v", "n"])

    return docs.select("text").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def spelling(docs: DataFrame) -> Spelling:
    """The table of at most ``TABLE`` words: all with a count that is reached by no more."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(LAYOUT_TEXTS)) == 0)
    counts = materialize(word_counts(some).withColumn("n", F.col("n") * LAYOUT_TEXTS), "words")
    by_size = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("places")).toPandas().sort_values("size", ascending=False)
    inside = by_size[by_size["words"].cumsum() <= TABLE]
    least = int(inside["size"].min()) if len(inside) else 1 << 30
    found = counts.where((F.floor(F.log2("n") * 16) >= least) & ~F.col("v").isin(END, PAD, UNKNOWN)).toPandas().sort_values(["n", "v"], ascending=False)
    pads = counts.where(F.col("v") == PAD).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drop_shared(counts)
    release_shuffles(docs.sparkSession)
    n = np.concatenate([[0, pads, 0], found["n"].to_numpy(np.int64)])
    words = np.concatenate([np.array([END, PAD, UNKNOWN], np.uint64), found["v"].to_numpy(np.int64).view(np.uint64)])
    return Spelling(words, 1 + n // SPLIT, max(LEAST_SHARDS, 1 + int(by_size["places"].sum()) // SHARD_PLACES))


def _contexts(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted triples: v, u, total, and how often the counts one, two and more of each context: of pairs (u, v), then of single words (u is END)."""
    pairs, first, place = np.unique(mixed(u, v), return_index=True, return_inverse=True)
    add = lambda x, place, size: np.bincount(place, x, size).astype(np.int64)
    ofs = [(v[first], u[first], n, place, len(pairs))]
    of = np.flatnonzero(_runs(v, w))
    new = _runs(v[of])
    singles = v[of][new]
    ofs.append((singles, np.full(len(singles), END, np.uint64), np.diff(np.append(of, len(v))), np.cumsum(new) - 1, len(singles)))
    rows = [(a, b, add(x, p, k), *(add(y, p, k) for y in (x == 1, x == 2, x >= 3))) for a, b, x, p, k in ofs]
    return tuple(np.concatenate(c) for c in zip(*rows))


def _part(kind: int, size: int, **columns) -> pa.Table:
    kinds = {"kind": pa.int32(), "shard": pa.int32(), "triples": pa.binary()}
    made = {"kind": pa.array(np.full(size, kind, np.int32))}
    for name in ("shard", "v", "u", "total", "n1", "n2", "n3", "triples"):
        x, of = columns.get(name), kinds.get(name, pa.int64())
        if isinstance(x, np.ndarray):
            x = x.view(np.int64) if x.dtype == np.uint64 else x
        made[name] = pa.nulls(size, of) if x is None else pa.array(x, of)
    return pa.table(made)


def model_parts(texts: DataFrame, shared) -> DataFrame:
    """Rows of PARTS: each shard's triples with counts, contexts of words in several shards, how many different words
    stand before each word, and counts of counts of both orders."""

    def cut(batches):
        sp = shared.value
        for b in slices(batches, "text", PAGE_BYTES):
            names, flat = words_of(b.column("text").to_pylist())
            codes, rare = sp.spell(names)
            u, v, w, text = _triples(flat)
            real = w != END
            u, v, w, text = u[real], v[real], w[real], text[real]
            shard = sp.shard(names, codes, v, w)
            found = list(_blocks(codes[u], codes[v], codes[w], text, rare, shard, len(sp.words), False))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["shard", "triples"])

    def add_up(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sp, shard = shared.value, key[0].as_py()
        found, table = [unpacked(b) for b in rows.column("triples").to_pylist()], len(sp.words)
        rare = np.unique(np.concatenate([x[0] for x in found]))
        own = np.arange(table)
        u, v, w = (np.concatenate([_looked_up(x[k], own, table + np.searchsorted(rare, x[0])) for x in found]) for k in (1, 2, 3))
        n = np.concatenate([x[4] for x in found])
        del found
        order = np.argsort(v << 42 | w << 21 | u) if table + len(rare) <= 1 << 21 else np.lexsort((u, w, v))
        u, v, w, n = u[order], v[order], w[order], n[order]
        first = np.flatnonzero(_runs(v, w, u))
        n = np.add.reduceat(n, first)
        u, v, w = u[first], v[first], w[first]
        of = np.flatnonzero(_runs(v, w))
        c2 = np.diff(np.append(of, len(v)))
        c1 = np.bincount(w[of], minlength=table + len(rare))
        names = np.concatenate([sp.words, rare])
        split = sp.parts_of(v) > 1
        context = _contexts(*(names[x[split]] for x in (u, v, w)), n[split])
        block = packed(u, v, w, rare, table, n)
        ends, c1 = names[c1 > 0], c1[c1 > 0]
        of_counts = [[int((x == k).sum()) for x in (n, c2)] for k in (1, 2, 3, 4)]
        names = ("v", "u", "total", "n1", "n2", "n3")
        return pa.concat_tables([
            _part(MODEL, 1, shard=[shard], triples=[block]),
            _part(CONTEXT, len(context[0]), **dict(zip(names, context))),
            _part(ENDING, len(ends), v=ends, total=c1, shard=np.full(len(ends), shard, np.int32)),
            _part(COUNTS, 2, v=[3, 2], **dict(zip(names[2:], of_counts))),
        ])

    blocks = texts.select("text").mapInArrow(cut, "shard int, triples binary")
    return blocks.groupBy("shard").applyInArrow(add_up, PARTS)


@dataclass
class Numbers:
    """What all shards share: discounts by order, the unigrams' sums, counts of the table's words, and the filter."""

    spelling: Spelling
    discounts: dict
    total: int
    left: float
    alphabet: int
    counts: np.ndarray
    bits: np.ndarray

    def own(self, order: int, n: np.ndarray) -> np.ndarray:
        return np.maximum(n - np.array([0.0, *self.discounts[order]])[np.minimum(n, 3)], 0.0)

    def unigram(self, n: np.ndarray) -> np.ndarray:
        """Probabilities of words with so many different words before them."""
        return (self.own(1, n) + self.left / (self.alphabet + 1.0)) / self.total

    def known(self, names: np.ndarray) -> np.ndarray:
        """False for words that no trusted text has; true for the others and by chance."""
        at = names & np.uint64((1 << FILTER_BITS) - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Values:
    """Numbers by name; zero where there is none. The leading bits of a name say where to look."""

    def __init__(self, names: np.ndarray, values: np.ndarray):
        order = np.argsort(names)
        self.names, self.values = names[order], values[order]
        bits = max(1, len(names).bit_length())
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted((self.names >> self.shift).astype(np.int64), np.arange((1 << bits) + 1))

    def __call__(self, names: np.ndarray) -> np.ndarray:
        slot = (names >> self.shift).astype(np.int64)
        at, end = self.starts[slot], self.starts[slot + 1]
        out = np.zeros(len(names), self.values.dtype)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = self.names[here] == names[todo]
            out[todo[hit]] = self.values[here[hit]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Shard:
    """What triples of a shard add to the log10 probability of a text."""

    def __init__(self, numbers: Numbers, parts: pa.Table):
        self.numbers = numbers
        sp, kinds = numbers.spelling, parts.column("kind").to_numpy()
        column = lambda rows, c: rows.column(c).to_numpy().astype(np.int64)
        rare = parts.filter(pa.array(kinds == ENDING))
        self.rare = Values(column(rare, "v").view(np.uint64), column(rare, "total"))
        blocks = [b for b in parts.column("triples").to_pylist() if b is not None]
        empty = np.empty(0, np.int64)
        rare, u, v, w, n = unpacked(blocks[0]) if blocks else (np.empty(0, np.uint64), *[empty] * 4)
        whole = sp.parts_of(v) == 1
        names = np.concatenate([sp.words, rare])
        u, v, w = names[u], names[v], names[w]
        own = _contexts(u[whole], v[whole], w[whole], n[whole])
        given = parts.filter(pa.array(kinds == CONTEXT))
        of_v, of_u, total, n1, n2, n3 = (np.concatenate([a, column(given, c).view(a.dtype)]) for a, c in zip(own, ("v", "u", "total", "n1", "n2", "n3")))
        d = np.where((of_u == END)[:, None], numbers.discounts[2], numbers.discounts[3])
        left = d[:, 0] * n1 + d[:, 1] * n2 + d[:, 2] * n3
        self.context = Values(mixed(of_u, of_v), np.arange(1, len(left) + 1))
        self.weights, left, total = (np.append(x, y) for x, y in ((0.0, np.log10(left / total)), (1.0, left), (1.0, total)))
        pair = _runs(v, w)
        of = np.flatnonzero(pair)
        c2 = np.diff(np.append(of, len(v)))
        single = self.context(mixed(np.full(len(of), END, np.uint64), v[of]))
        lower = left[single] * self.unigram(w[of])
        p2 = (numbers.own(2, c2) + lower) / total[single]
        self.two = Values(mixed(v[of], w[of]), np.log10(p2 * total[single] / lower))
        lower = left[self.context(mixed(u, v))] * p2[np.cumsum(pair) - 1]
        self.three = Values(mixed(u, v, w), np.log10((numbers.own(3, n) + lower) / lower))

    def weight(self, names: np.ndarray) -> np.ndarray:
        return self.weights[self.context(names)]

    def unigram(self, names: np.ndarray) -> np.ndarray:
        codes = self.numbers.spelling.codes(names)
        return self.numbers.unigram(np.where(codes >= 0, self.numbers.counts[codes], self.rare(names)))

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whole numbers of 2 ** -FRACTION for triples in the order of a block."""
        new, pair = _runs(v), _runs(v, w)
        at_v, at_pair = np.flatnonzero(new), np.flatnonzero(pair)
        one, two = v[at_v], (v[at_pair], w[at_pair])
        own = np.where(one == PAD, 0.0, np.log10(self.unigram(one)))
        inner = self.weight(mixed(u, v)) + self.three(mixed(u, v, w))
        inner += self.weight(mixed(np.full(len(one), END, np.uint64), one))[np.cumsum(new) - 1] + self.two(mixed(*two))[np.cumsum(pair) - 1]
        out = own[np.cumsum(new) - 1] + np.where(w == END, 0.0, inner)
        return np.rint(out * (1 << FRACTION)).astype(np.int64)


def learn(texts: DataFrame, sp: Spelling) -> tuple[DataFrame, Numbers | None]:
    """Rows of PARTS by shard (the shard's triples, contexts of split words, counts of its words beyond the table), and the shared numbers; none without n-grams."""
    from newsmill.llm.ngram_quality import discounts_of

    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(sp)
    parts = materialize(model_parts(texts, shared), "word-model")
    release_shuffles(spark)
    endings = materialize(parts.where(F.col("kind") == ENDING).groupBy("v").agg(F.sum("total").alias("total")), "endings")
    names = ("total", "n1", "n2", "n3")
    found = {r.v: [r[c] for c in names] for r in parts.where(F.col("kind") == COUNTS).groupBy("v").agg(*(F.sum(c).alias(c) for c in names)).collect()}
    one = endings.agg(F.count(F.lit(1)).alias("words"), F.sum("total").alias("all"), *(F.count_if(F.col("total") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    if not one.words:
        return parts, None
    found[1] = [one[f"n{k}"] for k in (1, 2, 3, 4)]
    discounts = {k: discounts_of(n) for k, n in found.items()}
    more = one.words - found[1][0] - found[1][1]
    left = sum(d * n for d, n in zip(discounts[1], (found[1][0], found[1][1], more)))

    def of_table(inside: bool):
        def run(batches):
            for b in batches:
                at = shared.value.codes(b.column("v").to_numpy().view(np.uint64)) >= 0
                yield b.filter(pa.array(at if inside else ~at))

        return run

    bit = F.col("v").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = endings.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("b")).toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[words.column("at").to_numpy()] = words.column("b").to_numpy()
    common = endings.mapInArrow(of_table(True), endings.schema).toArrow()  # at most TABLE rows
    counts = np.zeros(len(sp.words), np.int64)
    counts[sp.codes(common.column("v").to_numpy().view(np.uint64))] = common.column("total").to_numpy()
    numbers = Numbers(sp, discounts, one["all"], left, one.words, counts, bits.view(np.uint64))

    def homes(batches):
        for b in batches:
            v = b.column("v").to_numpy().view(np.uint64)
            k = shared.value.parts_of(shared.value.codes(v)).astype(np.int64)
            row = np.repeat(np.arange(len(v)), k)
            shard = shared.value.place(v[row], (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)).astype(np.uint64))
            both = np.unique(np.stack([row, shard]), axis=1)  # two parts of a word may share a shard
            out = b.take(pa.array(both[0]))
            yield out.set_column(out.schema.get_field_index("shard"), "shard", pa.array(both[1], pa.int32()))

    rare = endings.mapInArrow(of_table(False), endings.schema)
    at_home = rare.select(F.lit(None).cast("int").alias("shard"), "v").mapInArrow(homes, "shard int, v long")
    asked = parts.where(F.col("kind") == ENDING).select("shard", "v").mapInArrow(of_table(False), "shard int, v long")
    counted = asked.unionByName(at_home).distinct().join(rare, "v").select(F.lit(ENDING).alias("kind"), "shard", "v", "total")
    split = parts.where(F.col("kind") == CONTEXT).groupBy("kind", "v", "u").agg(*(F.sum(c).alias(c) for c in names)).withColumn("shard", F.lit(None).cast("int"))
    split = split.mapInArrow(homes, split.schema)
    others = materialize(counted.unionByName(split, True), "word-model-rows")
    return parts.where(F.col("kind") == MODEL).unionByName(others, True), numbers


def score(docs: DataFrame, model: DataFrame, numbers: Numbers) -> DataFrame:
    """(id, lang, n_chars, n_tokens, logp) of the documents (id, lang, text)."""
    from newsmill.llm.ngram_quality import SCORED

    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def cut(batches):
        from pyspark import TaskContext

        page = TaskContext.get().partitionId() << 32
        sp = shared.value.spelling
        for b in slices(batches, "text", PAGE_BYTES):
            page += 1
            names, flat = words_of(b.column("text").to_pylist())
            of = np.where(shared.value.known(names), np.arange(len(names)), UNKNOWN)
            of[:3] = END, PAD, UNKNOWN
            start = np.flatnonzero(flat == PAD)
            n = np.diff(np.append(start, len(flat))) - 2
            codes, rare = sp.spell(names[np.unique(of)])
            spelt = np.zeros(len(names), np.int64)
            spelt[np.unique(of)] = codes
            flat = of[flat]
            u, v, w, text = _triples(flat)
            lost = np.bincount(text[v == UNKNOWN], minlength=len(n))
            u, v, w, text = (x[v != UNKNOWN] for x in (u, v, w, text))
            shard = sp.shard(names, spelt, v, w)
            found = list(_blocks(spelt[u], spelt[v], spelt[w], text, rare, shard, len(sp.words), True))
            chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).cast(pa.int64())
            own = pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), chars, pa.array(n, pa.int64()), pa.array(lost, pa.int64())], ["id", "lang", "n_chars", "n_tokens", "lost"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            shards = [s for s, _ in found] + [page % sp.shards]
            blocks, texts = [x for _, x in found] + [None], [None] * len(found) + [sink.getvalue().to_pybytes()]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([page] * len(shards), pa.int64()), pa.array(blocks, pa.binary()), pa.array(texts, pa.binary())], ["shard", "page", "block", "texts"])

    def add_up(asked: pa.Table, parts: pa.Table) -> pa.Table:
        own, sums, words = Shard(shared.value, parts) if asked.num_rows else None, [], shared.value.spelling.words
        for block in asked.column("block"):
            if not block.is_valid:
                sums.append(None)
                continue
            rare, *triple, per, docs_of, counts = unpacked(block.as_buffer())
            first = np.zeros(len(docs_of), bool)
            first[np.cumsum(per + 1) - per - 1] = True
            place = _from_starts(docs_of, first)
            value = np.repeat(own.score(*(_looked_up(x, words, rare) for x in triple)), per + 1) * (counts + 1)
            added = np.zeros(int(place.max()) + 1, np.int64)
            np.add.at(added, place, value)
            found = np.flatnonzero(np.bincount(place))
            sums.append(struct.pack("<I", len(found)) + _squeezed(np.diff(found, prepend=0)) + _squeezed(-added[found]))
        return pa.table({"page": asked.column("page"), "sums": pa.array(sums, pa.binary()), "texts": asked.column("texts")})

    def gather(rows: pa.Table) -> pa.Table:
        own = pa.ipc.open_stream(next(x for x in rows.column("texts").to_pylist() if x is not None)).read_all()
        total = np.zeros(own.num_rows, np.int64)
        for raw in rows.column("sums").to_pylist():
            if raw is not None:
                (n,) = struct.unpack_from("<I", raw, 0)
                at, end = _expanded(memoryview(raw), 4, n, "<i8")
                total[np.cumsum(at)] -= _expanded(memoryview(raw), end, n, "<i8")[0]
        logp = total / (1 << FRACTION) + own.column("lost").to_numpy() * np.log10(shared.value.unigram(np.zeros(1, np.int64))[0])
        return own.drop_columns(["lost"]).append_column("logp", pa.array(logp))

    done = None
    for k in range(ROUNDS):
        release_shuffles(docs.sparkSession)
        some = docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)) == k).select("id", "lang", "text")
        asked = some.mapInArrow(cut, "shard int, page long, block binary, texts binary")
        sums = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(add_up, "page long, sums binary, texts binary")
        found = materialize(sums.groupBy("page").applyInArrow(gather, SCORED), "scores")
        done = found if done is None else done.unionByName(found)
    return done
