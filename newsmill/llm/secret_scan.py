"""Secret scans: fixed patterns and, in credential contexts, the guess cost of a value.

Fixed patterns give the spans ``assign``, ``access`` and ``hex``. Besides, a value that
stands in a credential context (a key name such as *password*, *pwd*, *auth* or
*credential*, a separator, the value, which a quote ends if one begins it) gets a guess cost:
the cheapest segmentation into dictionary words, dates, repeats (of a character, or of a unit
of up to ``UNIT`` characters), keyboard walks and brute-force stretches, found by
dynamic programming over its positions, as log10 of the guesses. At ``min_log10_guesses``
or more the value is a span ``guess``.

The dictionary is a ranked list of words: the corpus's own (:func:`ranked_words`: the
(at most) ``DICTIONARY`` words that most documents hold, counted in Spark over all whole texts), after
the words that passwords are made of. A list of any other origin can be passed instead. Its
size is a parameter of the model, so what goes to the tasks is bounded. A secret that few
documents hold is no word of it.

Defined cases: a null text is empty; an empty text has no spans; a text of any length is
scanned whole; positions are code points, ends exclusive; an empty table gives an empty table
(and a dictionary of the fixed words). Rows are independent once the dictionary is known, so repeated
rows, ties and extra columns need nothing; a column with the name of the result is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.llm.batches import slices
from newsmill.session import materialize, ship_package

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|login)"""
    r"""["']?\s*(?:=>|:=|[:=])\s*(?:(["'])([^"'\r\n]+)\1|["']?([^\s"'<>]+))""",
    re.A | re.I,
)

# Words that passwords and placeholders are made of, commonest first; a word's guesses are its place here.
COMMON_WORDS = (
    "password secret token admin login welcome letmein changeme example default user test root guest master "
    "dragon monkey football baseball superman batman shadow sunshine princess summer winter spring autumn love "
    "hello world qwerty abc key api null none true false undefined string value your here insert placeholder "
    "redacted hidden removed env config database server client access private public auth pass word my the and "
    "for name email phone street house company office home computer internet android apple google orange banana "
    "chocolate coffee flower freedom hunter killer lovely michael jordan thomas robert daniel charlie andrew "
    "jessica ashley jennifer michelle pepper ginger cookie buster tigger soccer hockey ranger starwars trustno "
    "whatever computer service demo sample temp temporary dummy foo bar baz"
).split()
#: Words of the corpus's dictionary, documents that hold each at least, letters of a word.
DICTIONARY, LEAST_DOCS, LETTERS = 20_000, 5, (3, 24)
#: A word of the dictionary: letters (and numerals that are no digits, such as fractions).
LETTER_RUN = re.compile(r"[^\W\d_]+")
#: Different words that a task counts before it hands their counts on; results don't depend on it.
COUNTED_WORDS = 200_000
#: Characters of a repeated unit at most.
UNIT = 16
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
#: log10 of the characters to try for one place of a brute-force stretch.
CLASS_COST = {"digit": 1.0, "lower": math.log10(26), "upper": math.log10(26), "other": math.log10(33)}
#: log10 of the choice of one more segment, and the cost of a joint between two.
SEGMENT_COST, JOINTS, JOINT_COST = 0.3, "_-. ", 0.5


def _neighbours() -> dict[str, frozenset[str]]:
    """Keys that touch on a staggered keyboard, both cases alike."""
    at = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    near = {}
    for c, (x, y) in at.items():
        near[c] = frozenset(d for d, (u, v) in at.items() if d != c and (abs(y - v), abs(x - u)) in ((0, 1), (1, 0), (1, 1)))
    return near


NEAR = _neighbours()


def _class_cost(c: str) -> float:
    kind = "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "other"
    return CLASS_COST[kind]


class Guesser:
    """Guess costs under a list of words, the likeliest first."""

    def __init__(self, words: Iterable[str] = ()):
        self.rank: dict[str, int] = {}
        for listed in (COMMON_WORDS, words):
            for i, w in enumerate(listed):
                self.rank[w] = min(i + 1, self.rank.get(w, i + 1))
        self.longest = max(map(len, self.rank))
        self.log10_guesses = lru_cache(4096)(self._log10_guesses)

    def _log10_guesses(self, value: str) -> float:
        """The least cost of a segmentation; the work grows with the value's length times that of the longest word.

        best[i] is the cost of value[:i]. A run of equal characters or a walk, of three or more, is left
        at any place if it is entered where it starts, and at its end if it is entered later. A unit of
        more characters is repeated, in whole, as often as it goes on.
        """
        low, n = value.lower(), len(value)
        if len(low) != n:  # a few letters change their length in lower case
            low = value
        best = [0.0] + [math.inf] * n
        brute_open = [math.inf] * (n + 1)  # the last segment is a brute-force stretch
        costs = [_class_cost(c) for c in value]
        before = list(accumulate(costs, initial=0.0))
        run, walk = [1] * n, [1] * n  # from i: equal characters; neighbouring or successive ones
        for i in range(n - 2, -1, -1):
            a, b = low[i], low[i + 1]
            if a == b:
                run[i] = run[i + 1] + 1
            if b in NEAR.get(a, ()) or abs(ord(a) - ord(b)) == 1:
                walk[i] = walk[i + 1] + 1
        units: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # from i: (length of the unit, whole repeats)
        for size in range(2, min(UNIT, n // 2) + 1):
            same = 0  # characters from i on that equal those ``size`` later
            for i in range(n - size - 1, -1, -1):
                same = same + 1 if low[i] == low[i + size] else 0
                if same >= size:
                    units[i].append((size, 1 + same // size))
        for i in range(n):
            here, cost = best[i], costs[i]
            brute = min(here + SEGMENT_COST, brute_open[i]) + cost
            brute_open[i + 1] = min(brute_open[i + 1], brute)
            best[i + 1] = min(best[i + 1], brute, here + JOINT_COST if value[i] in JOINTS else brute)
            for j in range(i + 2, min(n, i + self.longest) + 1):
                rank = self.rank.get(low[i:j])
                if rank:
                    case = 0.0 if value[i:j] == low[i:j] else 0.6
                    best[j] = min(best[j], here + SEGMENT_COST + math.log10(rank) + case)
            if value[i].isdigit() and (m := DATE.match(value, i)):
                best[m.end()] = min(best[m.end()], here + SEGMENT_COST + (4.6 if m.end() - i > 4 else 2.1))
            for runs, first in ((run, cost), (walk, math.log10(47))):
                starts = i == 0 or runs[i - 1] == 1
                for k in range(3, runs[i] + 1) if starts else range(max(3, runs[i]), runs[i] + 1):
                    best[i + k] = min(best[i + k], here + SEGMENT_COST + first + math.log10(k))
            for size, k in units[i]:
                rank = self.rank.get(low[i : i + size])
                unit = min(before[i + size] - before[i], math.log10(rank) if rank else math.inf)
                j = i + size * k
                best[j] = min(best[j], here + SEGMENT_COST + unit + math.log10(k))
        return best[n]


def _counted_words(counts: Counter[str]) -> pa.RecordBatch:
    words = [w for w in counts if LETTERS[0] <= len(w) <= LETTERS[1]]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["w", "n"])


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, least_docs: int = LEAST_DOCS) -> list[str]:
    """The words that most documents hold, at most ``most``, ties by name; a row is a document.

    How many words have each count tells the border's count; the words above it and the first by name of the
    border's own leave the tasks, ``most`` together at most. Tasks count before they shuffle, and hand on
    what they have counted when that is ``COUNTED_WORDS`` words.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        counts: Counter[str] = Counter()
        for b in slices(batches, "text", 4 << 20):
            for text in b.column("text").to_pylist():
                counts.update(set(LETTER_RUN.findall((text or "").lower())))
                if len(counts) > COUNTED_WORDS:
                    yield _counted_words(counts)
                    counts.clear()
        yield _counted_words(counts)

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "w string, n long")
    ranked = materialize(counted.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs), "word-counts")
    by_count = ranked.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("n"))))
    above = by_count.where(F.col("upto") <= most).agg(F.min("n"), F.max("upto")).first()
    whole = [] if above[0] is None else ranked.where(F.col("n") >= above[0]).collect()
    border = by_count.where(F.col("upto") > most).agg(F.max("n")).first()[0]
    room = most - (above[1] or 0)
    tied = [] if border is None or not room else ranked.where(F.col("n") == border).orderBy("w").limit(room).collect()
    return [r.w for r in sorted(whole + tied, key=lambda r: (-r.n, r.w.encode()))]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def guess_spans(text: str, min_log10_guesses: float, guesser: Guesser) -> list[tuple[int, int, str, float]]:
    if "=" not in text and ":" not in text:
        return []
    found = []
    for m in CONTEXT.finditer(text):
        value, start = (m[2], m.start(2)) if m[1] else (m[3].rstrip(".,;:!?)]}"), m.start(3))
        cost = guesser.log10_guesses(value)
        if cost >= min_log10_guesses:
            found.append((start, start + len(value), "guess", cost))
    return found


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("log10_guesses", pa.float64())])
SCHEMA = "array<struct<kind:string,start:int,end:int,value:string,log10_guesses:double>>"


_guessers: dict = {}


def _guesser(words: Broadcast) -> Guesser:
    """One for each worker and list."""
    if words.value[0] not in _guessers:
        _guessers.clear()
        _guessers[words.value[0]] = Guesser(words.value[1])
    return _guessers[words.value[0]]


def _shared(docs: DataFrame, text_col: str, words: Sequence[str] | None) -> Broadcast:
    ship_package(docs.sparkSession)
    listed = ranked_words(docs, text_col) if words is None else list(words)
    return docs.sparkSession.sparkContext.broadcast((hash(tuple(listed)), listed))


def secrets_in(text: Column, words: Broadcast, min_log10_guesses: float = 10.0) -> Column:
    """All findings of a text by start, then kind in the order of :data:`KINDS`."""

    @F.arrow_udf(SCHEMA)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            t = t or ""
            spans = [(s, KINDS.index(k), e, None) for s, e, k in base_spans(t)]
            spans += [(s, KINDS.index(k), e, c) for s, e, k, c in guess_spans(t, min_log10_guesses, _guesser(words))]
            out.append([{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e], "log10_guesses": c} for s, k, e, c in sorted(spans, key=lambda x: x[:3])])
        return pa.array(out, pa.list_(FINDING))

    return find(text)


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets", min_log10_guesses: float = 10.0, words: Sequence[str] | None = None) -> DataFrame:
    """``docs`` and the array of findings; ``words`` is the dictionary, the corpus's own if it is None."""
    return docs.withColumn(out_col, secrets_in(F.col(text_col), _shared(docs, text_col, words), min_log10_guesses))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", min_log10_guesses: float = 10.0, words: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with every finding's span replaced by ``mark``; overlapping spans become one."""
    shared = _shared(docs, text_col, words)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            spans = [] if t is None else [x[:2] for x in base_spans(t) + guess_spans(t, min_log10_guesses, _guesser(shared))]
            at, parts = 0, []
            for s, e in sorted(spans):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append(None if t is None else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col)))


def joined(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "guess")
    return find_secrets(docs).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
