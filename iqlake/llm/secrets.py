"""Secret scans: fixed patterns, and the least number of guesses for values that stand where credentials do."""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps

#: The base patterns by kind, the group that is the secret itself, its least number of characters.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs of fewer characters would be dropped
)
#: Kind of the spans that the guess cost adds, after the base kinds in order.
GUESS = "guess"
KINDS = (*(k for k, *_ in BASE), GUESS)
#: Where credentials stand: a name and a sign before the value, or the place of a password in an address.
CONTEXTS = (
    re.compile(
        r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|auth(?:orization)?|(?:api|access|private|secret|client)[_\- ]?key)["']?\x20{0,8}[:=]>?\x20{0,8}(?:bearer\x20)?["'`]?([^\s"'`<>,;(){}\[\]|\\]{6,})""",
        re.IGNORECASE | re.ASCII,
    ),
    re.compile(r"://[^\s/:@]{1,256}:([^\s/:@]{6,})@", re.ASCII),
)
#: RE2 patterns that every text with a match of the above also matches: they pick the texts that are gone over.
SIEVE = r"(?i)(pass|pwd|secret|token|credential|bearer|auth|key)[a-z]*[\"']?\x20*[:=]", "AKIA[A-Z0-9]", "[0-9a-f]{24}", "://[^\\s/:@]+:"
#: Guesses that a value has to withstand to be a secret, as a power of two: about 10^10.
BITS = 33.0

#: Passwords that come first in any list, most common first.
COMMON = """123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein shadow
master 696969 michael mustang 666666 qwertyuiop 123321 batman trustno1 hunter 654321 jordan superman 1qaz2wsx 7777777 121212 000000 qazwsx
123qwe killer jennifer 555555 hello iloveyou starwars computer michelle jessica pepper 1111 zxcvbn 131313 freedom 777777 pass maggie
159753 aaaaaa ginger princess joshua cheese amanda summer love ashley nicole chelsea matthew access yankees 987654321 dallas austin thunder
admin changeme default example test secret welcome login root user guest token placeholder none null your""".split()
#: Characters that stand for letters, keyboard rows (each row is shifted to the right by half a key), their shifted forms.
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"}
ROWS = "`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./"
SHIFTED = "~!@#$%^&*()_+", " QWERTYUIOP{}|", ' ASDFGHJKL:"', " ZXCVBNM<>?"
DATES = re.compile(
    r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])))"
    r"|(?=((?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\4(?:19|20)\d\d))",
    re.ASCII,
)
YEARS = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)

#: Bits of a brute-force character, of beginning another segment, of a walk's first key and of each turn.
CHAR, SEGMENT, KEY, TURN = math.log2(10), 1.0, math.log2(47), 2.0
#: Bits of a date within a century, of the signs in one, of a year.
DATE, SIGNS, YEAR = math.log2(365.25 * 100), 2.0, math.log2(100)
#: Least and most characters of a word; longest unit of a repeat. A walk has at least three characters.
WORD_LEAST, WORD_MOST, UNIT = 3, 24, 8


def _keys() -> dict[str, tuple[int, int]]:
    return {c: (2 * x + y, y) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row) if c != " "}


KEYS = _keys()


class Words:
    """A word list: each word's place by frequency, read either way."""

    def __init__(self, words: list[str]):
        self.rank = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        self.back = {w[::-1]: i for w, i in self.rank.items()}

    def bits(self, text: str) -> float | None:
        """Bits of a word in any case, with signs for letters, read either way; null if it is none."""
        low, best = text.lower(), None
        plain = unsigned(low)
        signs = sum(a != b for a, b in zip(low, plain, strict=True))
        for rank, more in ((self.rank.get(low), 0), (self.rank.get(plain), signs), (self.back.get(low), 1)):
            if rank is not None:
                bits = math.log2(rank + 1) + more
                best = bits if best is None or bits < best else best
        upper = sum(c.isupper() for c in text)
        if best is None or not upper:
            return best
        letters = upper + sum(c.islower() for c in text)
        simple = upper == letters or (upper == 1 and (text[0].isupper() or text[-1].isupper()))
        return best + (1.0 if simple else math.log2(sum(math.comb(letters, i) for i in range(1, min(upper, letters - upper) + 1))))


def unsigned(low: str) -> str:
    """A text with letters for the signs that stand for them."""
    return "".join(LEET.get(c, c) for c in low)


@cache
def word_list(path: str | None) -> Words:
    """COMMON, then the words of a ``tokenizers`` file in the order they were merged, i.e. about that of frequency."""
    if not path:
        return Words(COMMON)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    # fixed value: the sign with which a word begins in byte-level files
    plain = [t[1:].lower() for t in sorted(vocab, key=vocab.get) if t.startswith("Ġ") and t[1:].isascii() and t[1:].isalpha()]
    return Words([*COMMON, *(w for w in plain if WORD_LEAST <= len(w) <= WORD_MOST)])


def _near(a: str, b: str) -> tuple[int, int] | None:
    """The direction from one key to a neighbouring one, null where they aren't neighbours."""
    if (p := KEYS.get(a)) is None or (q := KEYS.get(b)) is None:
        return None
    x, y = q[0] - p[0], q[1] - p[1]
    return (x, y) if (y == 0 and abs(x) == 2) or (abs(y) == 1 and abs(x) == 1) else None


def _repeats(value: str, unit_bits: Callable[[str], float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits): runs of one unit of up to UNIT characters, at least twice and over three characters in all."""
    n = len(value)
    for p in range(1, UNIT + 1):
        i = p
        while i < n:
            if value[i] != value[i - p]:
                i += 1
                continue
            a = i - p
            while i < n and value[i] == value[i - p]:
                i += 1
            times = (i - a) // p
            if times >= 2 and p * times >= 3:
                yield a, a + p * times, unit_bits(value[a : a + p]) + math.log2(times)


def given_spans(value: str, known: Words) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of the dates, years and repeats in a value."""
    for m in DATES.finditer(value):
        text, sign = (m[1], m[2]) if m[1] else (m[3], m[4])
        yield m.start(), m.start() + len(text), DATE + (SIGNS if sign else 0.0)
    for m in YEARS.finditer(value):
        yield m.start(), m.start() + 4, YEAR
    yield from _repeats(value, cache(lambda unit: _cheapest(unit, known, {})))


def guess_bits(value: str, known: Words) -> float:
    """log2 of the least number of guesses: the cheapest cut of ``value`` into words, dates, repeats, keyboard walks and
    brute-force spans, each with SEGMENT bits for its kind."""
    given: dict[int, list[tuple[int, float]]] = {}
    for a, b, bits in given_spans(value, known):
        given.setdefault(b, []).append((a, bits))
    return _cheapest(value, known, given)


def _cheapest(value: str, known: Words, given: Mapping[int, list[tuple[int, float]]]) -> float:
    """The cheapest cut by one pass: what the way to each place costs, with a brute-force span or a walk open there or closed.

    A word has at most WORD_MOST characters and any other span is extended by one character at a time or known beforehand
    (``given``, by where it ends), so the work is linear in the value's length.
    """
    n, inf = len(value), math.inf
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)  # a few capitals have longer small forms
    plain = unsigned(low)
    best, brute = [0.0] + [inf] * n, inf
    pair = walk = inf  # the cheapest way that ends in an open walk of two characters, of three or more
    came = None
    for i in range(1, n + 1):
        brute = min(brute, best[i - 1] + SEGMENT) + CHAR
        step = _near(value[i - 2], value[i - 1]) if i > 1 else None
        if step is None:
            pair = walk = inf
        else:
            walk = min(walk, pair) + (0.0 if step == came else TURN)
            pair = best[i - 2] + SEGMENT + KEY + TURN
        came = step
        cheapest = min(brute, walk)
        for a in range(max(0, i - WORD_MOST), i - WORD_LEAST + 1):
            word = low[a:i]
            if word in known.rank or plain[a:i] in known.rank or word in known.back:
                bits = known.bits(value[a:i])
                if bits is not None and (cost := best[a] + SEGMENT + bits) < cheapest:
                    cheapest = cost
        for a, bits in given.get(i, ()):
            if (cost := best[a] + SEGMENT + bits) < cheapest:
                cheapest = cost
        best[i] = cheapest
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, value) of the base patterns' matches, leftmost first per kind; those whose secret is too short are dropped.

    value: where the secret itself begins; it ends with the match.
    """
    return [(kind, *m.span(), m.start(group)) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if len(m[group]) >= least]


def spans_of(text: str, known: Words, bits: float = BITS) -> list[tuple[str, int, int, int, float | None]]:
    """All spans of a text in order of start, then kind: base ones, and values in credential contexts with so many bits.

    A value that lies within one base find's secret is known already and isn't added again.
    """
    base = base_spans(text)
    found: dict[tuple[str, int, int], tuple[int, float | None]] = {(k, a, b): (v, None) for k, a, b, v in base}
    inside = _covers([(k, v, b) for k, _, b, v in base])
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if not inside(a, b) and (cost := guess_bits(m[1], known)) >= bits:
                found[GUESS, a, b] = a, cost
    return [(*key, *rest) for key, rest in sorted(found.items(), key=lambda e: (e[0][1], KINDS.index(e[0][0]), e[0][2]))]


def _covers(spans: list[tuple[str, int, int]]):
    """A test whether a range lies within one of the spans."""
    order = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in order], []
    for _, b in order:
        reach.append(max(b, reach[-1] if reach else b))
    return lambda a, b: bool(k := bisect_right(starts, a)) and reach[k - 1] >= b


_SPANS = "doc_id long, spans array<struct<kind:string,start:int,stop:int,value:int,bits:double>>"


def scan(docs: DataFrame, words: str | None = None, bits: float = BITS) -> DataFrame:
    """Find secrets in every whole text.

    Base spans come from fixed patterns: what is assigned to a password, token or key, access key ids, long hexadecimal numbers.
    More are added by guess cost: each value in a wider set of credential contexts (pass phrases, bearer headers, passwords in
    addresses, values with signs that the base pattern doesn't take) is cut into the words, dates, repeats, keyboard walks and
    brute-force spans that are cheapest to guess, and is a secret if that takes 2 to the power of ``bits`` guesses or more.
    ``words``: a ``tokenizers`` file whose words, in order of merging, are the word list after COMMON; every machine has it.

    Returns (doc_id, spans): spans holds (kind, start, stop, value, bits) in code points, stop exclusive, in order of start and kind.
    A base span is the whole match, name and sign included; value is where the secret itself begins, which ends at stop; bits is
    null for base spans; no two are equal. Null and empty texts have none. Each row stands for itself, repeated ids too. Bytes
    that aren't UTF-8 count as one character each. An empty table gives no rows; other columns are not looked at. The work is
    linear in a text's length, whatever it holds.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.int32()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_list(words)
        for batch in batches:
            for part in steps(batch, most=1 << 22):
                texts = part.column(1).cast(pa.large_binary()).fill_null(b"")
                hit = None
                for pattern in SIEVE:
                    one = pc.match_substring_regex(texts, pattern)
                    hit = one if hit is None else pc.or_(hit, one)
                rows = [[]] * len(texts)
                for k in pc.indices_nonzero(hit).to_pylist():
                    found = spans_of(texts[k].as_py().decode("utf-8", "replace"), known, bits)
                    rows[k] = [{"kind": t, "start": a, "stop": b, "value": v, "bits": c} for t, a, b, v, c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SPANS)


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, words: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): counts per base kind, a digest of the base spans, all spans as text."""
    found = scan(docs, words)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    number = [F.size(of(k)).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    base = F.sha2(listed(F.filter("spans", lambda s: s["kind"] != GUESS)).cast("binary"), 256)
    return found.select("doc_id", *number, base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))
