"""Secret scan: patterns, and password guess costs of values in credential contexts.

The patterns find assignments, access keys and hex strings.  Values behind a
credential word are split into dictionary words, dates, repeats, keyboard
walks, sequences and brute-force spans so that the guesses needed are fewest
(a dynamic program over the value, exact over all segmentations); values that
take at least 10**`STRONG` guesses are spans of kind `guess`, placeholders are
not.

The dictionary is ranked: common passwords first, then the words of 3 to
`WORD_MOST` letters that most documents hold outside of credential values,
counted over all documents.  It holds `DICTIONARY` words at most (a parameter),
so it may be broadcast.

Defined cases: null text is empty; texts without spans have zero counts, an
empty list and the hash of the empty string; equal texts get equal rows,
repeated rows stay; texts and values are processed whole whatever their
length; offsets are code points; words that equally many documents hold are
ranked by their letters; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import Workspace, table
from .resampling import kth_largest

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words in whose context a value is judged by its guess cost, and the value: quoted, or up to white space.
CONTEXT = re.compile(r"""(?i:password|passwd|passphrase|pwd|credential|secret|token|api_?key)["']?[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"'<>,;]+))""", re.ASCII)
HINTS = ("passw", "passphrase", "pwd", "credential", "secret", "token", "apikey", "api_key")
STRONG = 8.0
SHORTEST = 8
PARTIAL = 200_000

#: Common password words, most common first.
COMMON = """password 123456 12345678 qwerty abc123 monkey letmein dragon 111111 baseball iloveyou trustno1 sunshine master welcome
shadow ashley football jesus michael ninja mustang password1 admin root user guest test login secret changeme default example
sample demo temp hello world love god money summer winter spring autumn monday friday january december server system manager
access token key pass word private public service account database backup oracle cisco super power magic happy star blue green
red black white orange computer internet google apple banana cookie coffee chocolate pepper ginger buster tigger soccer hockey
killer george charlie andrew michelle jessica daniel thomas jordan hunter harley ranger batman superman none null your here
placeholder redacted xxxx todo value string insert replace enter""".split()
#: Keyboard rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Letters that stand in for others.
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "!": "i", "8": "b"}

DICTIONARY = 50_000
WORD_MOST = 15
LEAST_DOCUMENTS = 3
_WORD = re.compile(rf"(?<![a-z])[a-z]{{3,{WORD_MOST}}}(?![a-z])")
_PLACE = {c: (r, i - (r == 0)) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DAY, _MONTH = r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0?[1-9])"
_DATE = re.compile(rf"(?:19|20)\d\d([-/._]?){_MONTH}\1{_DAY}|{_DAY}([-/._]?){_MONTH}\2(?:(?:19|20)?\d\d)|(?:19|20)\d\d")
_DATE_MOST = 10
_PENALTY = 0.5  # log10 of the choices of where a further segment starts
_RUN = 3  # least length of a repeat, sequence, walk or word


class Dictionary:
    """Ranked words."""

    def __init__(self, words: list[str] | None = None):
        ordered = list(dict.fromkeys([*COMMON, *(words or [])]))
        self.rank = {w: i + 1 for i, w in enumerate(ordered)}
        self.longest = max(map(len, ordered))

    def cost(self, piece: str, low: str, plain: str) -> float | None:
        """log10 of the guesses for a piece, given in lower case and with stand-ins undone, or None."""
        rank = self.rank.get(low)
        changed = 0
        if rank is None:
            if (rank := self.rank.get(plain)) is None:
                return None
            changed = sum(a != b for a, b in zip(low, plain, strict=True))
        upper = sum(c.isupper() for c in piece)
        variants = 1 if not upper else 2 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else 2**upper
        return math.log10(rank * variants * 2**changed + 1)


COMMON_ONLY = Dictionary()


def _beside(a: str, b: str) -> bool:
    (r, i), (s, j) = _PLACE[a], _PLACE[b]
    return (r, i) != (s, j) and abs(r - s) <= 1 and (abs(i - j) <= 1 if r == s else j - i in ((0, -1) if s > r else (0, 1)))


def _repeat(n: int) -> float:
    return math.log10(12.0 * n)


def _sequence(n: int) -> float:
    return math.log10(16.0 * n)


def _walk(n: int) -> float:
    return math.log10(94.0) + 0.45 * (n - 1)


class _Starts:
    """Starts from which a run's segment may still be cheapest, for costs that grow with the log of the length.

    Of two starts, the earlier one gains on the later as the end moves on: so a
    start goes once an earlier one is no dearer, and where an earlier one is no
    dearer in the end (its cost so far is at least the later one's).
    """

    def __init__(self) -> None:
        self.run, self.held = -1, []

    def add(self, run: int, a: int, cost: float) -> None:
        if run != self.run:
            self.run, self.held = run, []
        if any(c + math.log10((a + _RUN - b) / _RUN) <= cost for b, c in self.held):
            return
        self.held = [(b, c) for b, c in self.held if c < cost] + [(a, cost)]


def _lower(value: str) -> str:
    """In lower case, code point by code point."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in value)


def guess_cost(value: str, words: Dictionary = COMMON_ONLY) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses a value takes, and its cheapest segmentation (kind, start, end).

    Each segment adds its cost, and each but the first the penalty; brute-force
    characters side by side are one segment, so the best costs of prefixes that
    end in one and of those that don't are kept apart.
    """
    n = len(value)
    low = _lower(value)
    plain = "".join(LEET.get(c, c) for c in low)
    brute, other = [math.inf] * (n + 1), [0.0] + [math.inf] * n
    back: list[tuple[str, int, bool]] = [("", 0, False)] * (n + 1)  # of `other`; whether its start is a `brute` prefix
    joined = [False] * (n + 1)  # whether the last brute-force character goes on from one
    repeat, step, walk = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # starts of the runs that hold the last character
    for i in range(1, n):
        delta = ord(low[i]) - ord(low[i - 1])
        repeat[i] = repeat[i - 1] if delta == 0 else i
        step[i] = (step[i - 1] if step[i - 1] < i - 1 and delta == ord(low[i - 1]) - ord(low[i - 2]) else i - 1) if abs(delta) == 1 else i
        walk[i] = walk[i - 1] if low[i] in _PLACE and low[i - 1] in _PLACE and _beside(low[i - 1], low[i]) else i
    dates: dict[int, list[int]] = {}
    for a in range(n):
        if "0" <= value[a] <= "9":
            for e in range(a + 4, min(n, a + _DATE_MOST) + 1):
                if _DATE.fullmatch(value, a, e):
                    dates.setdefault(e, []).append(a)
    starts = {"repeat": (repeat, _Starts(), _repeat), "sequence": (step, _Starts(), _sequence)}
    walked: tuple[int, float, int] = (-1, math.inf, 0)  # the run, and its cheapest start for costs that grow with the length

    for e in range(1, n + 1):
        def offer(kind: str, a: int, cost: float, e: int = e) -> None:
            total = min(brute[a], other[a]) + cost + (_PENALTY if a else 0.0)
            if total < other[e]:
                other[e], back[e] = total, (kind, a, brute[a] < other[a])

        fresh = other[e - 1] + (_PENALTY if e > 1 else 0.0)
        joined[e] = brute[e - 1] < fresh
        brute[e] = min(brute[e - 1], fresh) + 1.0
        for a in range(max(0, e - words.longest), e - _RUN + 1):
            if (cost := words.cost(value[a:e], low[a:e], plain[a:e])) is not None:
                offer("word", a, cost)
        for a in dates.get(e, ()):
            offer("date", a, math.log10(365.0 * 120) + (0.6 if not value[a:e].isdigit() else 0.0))
        a = e - _RUN
        before = min(brute[a], other[a]) if a >= 0 else math.inf
        for kind, (run, some, cost_of) in starts.items():
            if a >= run[e - 1]:
                some.add(run[e - 1], a, before + (_PENALTY if a else 0.0))
                for b, _ in some.held:
                    offer(kind, b, cost_of(e - b))
        if a >= (run_at := walk[e - 1]):
            slope = _walk(2) - _walk(1)
            if walked[0] != run_at:
                walked = (run_at, math.inf, a)
            if (here := before + (_PENALTY if a else 0.0) - slope * a) < walked[1]:
                walked = (run_at, here, a)
            offer("walk", walked[2], _walk(e - walked[2]))
    pieces, e, in_brute = [], n, brute[n] < other[n]
    while e:
        kind, a, into = ("brute", e - 1, joined[e]) if in_brute else back[e]
        pieces.append((kind, a, e))
        e, in_brute = a, into
    return min(brute[n], other[n]), pieces[::-1]


def corpus_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The words that most documents hold outside of credential values, at most `most`, by falling number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    low = _lower(text) if not text.isascii() else text.lower()
                    if any(h in low for h in HINTS):
                        low = CONTEXT.sub(" ", low)
                    found.update(set(_WORD.findall(low)))
            if len(found) > PARTIAL:
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ws = Workspace(docs.sparkSession, "words")
    counted = ws.save(counted.where(F.col("n") >= LEAST_DOCUMENTS), "counted")
    total = counted.count()
    if total <= most:
        rows = counted.collect()
    else:  # the border is found by counting, so that the driver never gets more than the dictionary
        edge, above = kth_largest(counted, "n", most)
        rows = counted.where(F.col("n") > edge).collect()
        rows += ws.save(counted.where(F.col("n") == edge).orderBy("word").limit(most - above), "ties").collect()
    ws.clear()
    return [r["word"] for r in sorted(rows, key=lambda r: (-r["n"], r["word"].encode()))]


def _counts(found: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def spans_of(text: str, words: Dictionary = COMMON_ONLY) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end) of every span of a text, in order."""
    found = [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        for m in CONTEXT.finditer(text):
            a, e = m.span(m.lastindex or 0)
            if e - a >= SHORTEST and guess_cost(text[a:e], words)[0] >= STRONG:
                found.append((a, 3, "guess", e))
    return sorted(found)


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{e}" for a, _, kind, e in spans)


def scan(docs: DataFrame, words: list[str] | None = None) -> DataFrame:
    """doc_id and its spans: arrays of kind, start, end, for each row of `docs` (doc_id, text); `words` extend the common ones."""
    shared = docs.sparkSession.sparkContext.broadcast(Dictionary(words))
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": e} for a, _, k, e in spans_of(t or "", shared.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def base_sha256(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, corpus_words(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("guess"))
