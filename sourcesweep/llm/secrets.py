"""Secrets in texts: three fixed formats, and a battery of randomness tests on everything that could be a key.

A candidate is a run of key characters, or a part of it between signs: names, paths and keys may be glued together. '=' is never
part of one, so values of NAME=value stand alone. Its encoding (hexadecimal, letters, base32, base36, base62, base64) is the
smallest alphabet that holds it; runs that none holds count by their parts. Three tests ask whether it is random in that alphabet: chi-squared for uniform use
of the characters, runs above and below the middle of the alphabet, and serial correlation of neighbours. The least of their
p-values is combined to 1 - (1 - p)^3, which would be uniform for real keys if the tests were independent and exact; what it is
instead, simulated keys of each encoding and length class tell. Values of words and numbers lie near zero, so the candidates above
one half, over the share of simulated keys there, give the number of keys, and for each length class and encoding the least
threshold is taken at which the estimated share of false discoveries stays below ``rate``.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_rows

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run, as shorter ones don't count
#: The order of kinds at one place.
KINDS = ("assign", "access", "hex", "random")

#: Shortest candidate, and the longest value of each length class but the last.
SHORTEST, CLASSES = 20, (23, 31, 39, 63, 127)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
_PARTS = tuple(re.compile("[%s]{%d,}" % (chars, SHORTEST)) for chars in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
_LETTER = re.compile(r"[A-Za-z]")
#: Bins of the p-value in the histogram over the corpus, and the accepted share of false discoveries.
BINS, RATE = 100, 0.01
#: Simulated keys for each encoding and length class, and the longest of the last class.
SIMULATED, LONGEST = 40_000, 255

#: Alphabets by size, smallest first; a value belongs to the first that holds all its characters.
ENCODINGS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("lower", "abcdefghijklmnopqrstuvwxyz"),
             ("UPPER", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
             ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
             ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
_SETS = [(n, frozenset(a), {c: k for k, c in enumerate(a)}) for n, a in ENCODINGS]

#: The kind of each character of an alphabet: digit, capital, small letter, sign; where there are only letters, also vowel or not.
_CELLS = {n: np.unique([c.isdigit() + 2 * c.isupper() + 3 * c.islower() + 4 * (a.isalpha() and c.lower() in "aeiou") for c in a], return_inverse=True)[1]
          for n, a in ENCODINGS}
#: For alphabets of letters only, how common each letter is in words: logarithms of shares, scaled to mean 0 and deviation 1.
_SHARES = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (12, 9, 8.1, 7.7, 7.3, 7, 6.3, 6, 5.9, 4.3, 4, 2.7, 2.9, 2.6, 2.3, 1.8, 2, 2.1, 2.1, 1.5, 1.1, .7, .2, .1, .1, .1)))
_COMMON = {n: (x - x.mean()) / x.std() for n, a in ENCODINGS if a.isalpha() for x in [np.log([_SHARES[c.lower()] for c in a])]}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and kind of the fixed formats, in code points, sorted by place and kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def candidates(text: str):
    """Runs that may be keys and their parts: (begin, end, value without padding, begin of the run), longer ones of a run first."""
    for m in _CANDIDATE.finditer(text):
        at = m.start()
        spans = {m.span()} | {(at + p.start(), at + p.end()) for part in _PARTS for p in part.finditer(m[0])}
        for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
            if _LETTER.search(text, s, e):
                yield s, e, text[s:e], at


def encoding(value: str) -> str | None:
    used = set(value)
    return next((n for n, chars, _ in _SETS if used <= chars), None)


def _tails(z: np.ndarray) -> np.ndarray:
    """Upper tails of the normal distribution."""
    return np.array([0.5 * math.erfc(v) for v in (z / math.sqrt(2)).tolist()])


def _chi_tails(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """p-values of chi-squared; the cube root of chi / df is close to normal."""
    df = len(expected) - 1
    chi = ((count - expected) ** 2 / expected).sum(1)
    return _tails(((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def p_values(x: np.ndarray, name: str) -> np.ndarray:
    """For each row of places in the alphabet, p-values of the chi-squared, runs and serial-correlation tests."""
    (rows, n), kind = x.shape, _CELLS[name]
    k = len(kind)
    count = np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k)
    # short values have few of each character, so kinds of characters are tested as well
    of_kind = np.stack([count[:, kind == j].sum(1) for j in range(kind.max() + 1)], 1)
    tails = [_chi_tails(count, np.full(k, n / k)), _chi_tails(of_kind, np.bincount(kind) * n / k)]
    if name in _COMMON:  # words use common letters
        tails.append(_tails(count @ _COMMON[name] / math.sqrt(n)))
    uneven = np.minimum(1.0, len(tails) * np.min(tails, 0))
    up = x >= k / 2
    pairs = 2.0 * up.sum(1) * (n - up.sum(1))
    var = pairs * (pairs - n) / (n * n * (n - 1))
    runs = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
    z = np.abs(runs - 1 - pairs / n) / np.sqrt(np.where(var > 0, var, 1))
    run = np.where(pairs == 0, 2.0 ** (1 - n), np.where(var > 0, 2 * _tails(z), 1.0))
    y = x - x.mean(1, keepdims=True)
    total = (y * y).sum(1)
    z = np.abs((y[:, :-1] * y[:, 1:]).sum(1) / np.where(total > 0, total, 1) + 1 / n) * math.sqrt(n)
    return np.stack([uneven, run, np.where(total > 0, 2 * _tails(z), 0.0)], 1)


def combined(p: np.ndarray) -> np.ndarray:
    return 1 - (1 - np.minimum(1.0, p.min(1))) ** p.shape[1]


def battery(value: str, name: str) -> tuple[float, float, float]:
    """p-values of the tests against random characters of the alphabet."""
    rank = next(r for n, _, r in _SETS if n == name)
    return tuple(p_values(np.array([[rank[c] for c in value]]), name)[0].tolist())


def randomness(value: str, name: str) -> float:
    """Combined p-value: small for what is not random."""
    return float(combined(np.array([battery(value, name)]))[0])


def length_class(n: int) -> int:
    return int(np.searchsorted(CLASSES, n))


def _bin(p: float) -> int:
    return min(BINS - 1, int(p * BINS))


@functools.lru_cache(maxsize=None)
def key_bins(name: str, size: int) -> np.ndarray:
    """Share of random keys of an encoding and length class in each bin, from ``SIMULATED`` of them; the same in every run."""
    low = SHORTEST if size == 0 else CLASSES[size - 1] + 1
    high = CLASSES[size] if size < len(CLASSES) else LONGEST
    rng = np.random.default_rng([size, *name.encode()])
    lengths = np.unique(np.linspace(low, high, min(8, high - low + 1)).astype(int))
    out = np.zeros(BINS)
    for n in lengths:
        p = combined(p_values(rng.integers(0, len(_CELLS[name]), (SIMULATED // len(lengths), n)), name))
        out += np.bincount(np.minimum(BINS - 1, (p * BINS).astype(int)), minlength=BINS)
    return out / out.sum()


def _judged(text: str):
    for s, e, value, run in candidates(text):
        name = encoding(value)
        if name:
            yield s, e, name, length_class(e - s), _bin(randomness(value, name)), run


def _accepted(text: str, accept: dict, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Candidates that pass and touch none of ``taken``; of those of a run that overlap, the longest."""
    out, own, last = [], [], -1
    for s, e, name, size, place, run in _judged(text) if accept else ():
        if run != last:
            own, last = [], run
        if place >= accept.get((name, size), BINS) and not any(s < b and a < e for x in (own, taken) for a, b in x):
            own.append((s, e))
            out.append((s, e))
    return out


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[tuple[str, int], int]:
    """Least accepted bin for each encoding and length class, from the histogram of all candidates of all documents.

    What comes to the driver is the histogram: at most encodings x classes x BINS rows.
    """
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType()),
                           T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])

    def work(batch):
        count: dict = {}
        for value in batch.column(0).to_pylist():
            for _, _, name, size, place, _ in _judged(value or ""):
                count[name, size, place] = count.get((name, size, place), 0) + 1
        rows = [(*k, v) for k, v in count.items()]
        return {c: [r[i] for r in rows] for i, c in enumerate(schema.names)}

    table: dict = {}
    for name, size, place, n in (map_rows(docs.select(F.col(text).alias("text")), work, schema, text="text")
                                 .groupBy("name", "size", "bin").agg(F.sum("n")).collect()):
        table.setdefault((name, size), np.zeros(BINS))[place] += n
    return {k: cut for k, v in table.items() if (cut := least_bin(v, rate, key_bins(*k))) is not None}


def least_bin(count: np.ndarray, rate: float, keys: np.ndarray | None = None) -> int | None:
    """The least bin from which on the estimated false share is at most ``rate`` (None: nothing is accepted).

    The upper half of the p-values, where only keys are, tells how many keys there are in each bin, by the share of keys in
    it (``keys``; default: equal). Chance makes the estimate uncertain by some root of the number, so what lies over the rate by
    less than one standard error is allowed; that is 2 % at 2,000 keys, and 0.2 % at 200,000.
    """
    share = np.full(BINS, 1 / BINS) if keys is None else keys
    half = BINS // 2
    upper = count[half:].sum()
    best = None
    for cut in range(BINS - 1, 0, -1):
        accepted, ratio = count[cut:].sum(), share[cut:].sum() / share[half:].sum()
        below = max(0.0, ratio - 1)
        error = math.sqrt((below + below * below) * upper)
        if accepted and accepted - ratio * upper <= rate * accepted + error:
            best = cut
    return best


def find_secrets(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each document: doc_id and spans (begin, end, kind), in code points, sorted by place and kind.

    Values that pass the tests and touch no span of a fixed format are of kind ``random``. Null texts have no spans; equal
    rows give equal rows.
    """
    accept = thresholds(docs, text, rate)
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_].dataType), T.StructField("spans", T.ArrayType(span))])

    def work(batch):
        out = []
        for value in batch.column(1).to_pylist():
            spans = base_spans(value) if value else []
            taken = [(s, e) for s, e, _ in spans]
            spans += [(s, e, "random") for s, e in _accepted(value or "", accept, taken)]
            spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
            out.append([{"begin": s, "stop": e, "kind": k} for s, e, k in spans])
        return {"doc_id": batch.column(0), "spans": out}

    return map_rows(docs.select(F.col(id_), F.col(text).alias("text")), work, schema, text="text")


def redact(docs: DataFrame, *, text: str = "text", rate: float = RATE, mark: str = "<SECRET>") -> DataFrame:
    """The documents, with their columns, with every secret in the text replaced by ``mark``."""
    accept, columns = thresholds(docs, text, rate), docs.columns

    def work(batch):
        out = []
        for value in batch.column(text).to_pylist():
            if value:
                spans = [(s, e) for s, e, _ in base_spans(value)]
                spans += _accepted(value, accept)
                parts, last = [], 0
                for s, e in sorted(spans):
                    if s >= last:
                        parts += [value[last:s], mark]
                    last = max(last, e)
                value = "".join([*parts, value[last:]])
            out.append(value)
        return {c: batch.column(c) for c in columns} | {text: out}

    return map_rows(docs, work, docs.schema, text=text)
