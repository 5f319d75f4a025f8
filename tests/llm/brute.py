"""Plain versions of what the queries return, row by row and pair by pair."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np

from sourcesweep.llm import words as W

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def named(found):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def secrets_base(text):
    text = text or ""
    kinds = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    return sorted(((m.start(), m.end(), k) for k, p, ok in kinds for m in p.finditer(text) if ok(m)), key=lambda x: (x[0], "assign access hex".split().index(x[2])))


def contamination(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = LETTERS.findall(lower(text))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(str(name))
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w, hit, found = LETTERS.findall(lower(text)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[t]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def near(docs, size=2, percent=80):
    sets = {}
    for d, text in docs:
        w = SPACE.findall(lower(text))
        sets[d] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    common = Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def passages(docs, size=50):
    words, first = {d: SPACE.findall(t or "") for d, t in docs}, {}
    for d, w in words.items():
        for k in range(len(w) - size + 1):
            t = tuple(w[k:k + size])
            first[t] = min(first.get(t, d), d)
    out = {}
    for d, w in words.items():
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k:k + size])] < d for x in range(k, k + size)}
        out[d] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def chats(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        under = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(under), sha(under))
    return out


def quality(text):
    text = text or ""
    w = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    repeat = {x for k in range(len(w) - 4) if count[tuple(w[k:k + 5])] > 1 for x in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def private(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))
    names = [k for k, _, _ in kinds]
    return sorted(((m.start(), m.end(), k) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)), key=lambda x: (x[0], names.index(x[2])))


def divergences(rows, common=40, least_docs=10, least_reference=2000):
    """class and word distance (or None) and their verdict for each (lang, text), by counters over all rows."""
    kind = lambda c: ("beyond" if c > "\x7f" else "symbol" if c in "#*$%&|<>" else "stop" if c in ".,;:!?'\"()-" else "line" if c == "\n" else "small" if c.islower()
                      else "capital" if c.isupper() else "digit" if c.isdigit() else "space" if c.isspace() else "sign")
    words_of = lambda t: LETTERS.findall(lower(t))

    def tie(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return int(W.signed(W.hashes(raw, np.array([0]), np.array([len(raw)])))[0])

    def apart(p, q):
        p, q = ({k: n / max(sum(x.values()), 1) for k, n in x.items()} for x in (p, q))
        bits = lambda a, b: sum(x * math.log2(2 * x / (x + b.get(k, 0))) for k, x in a.items() if x)
        return math.sqrt(max((bits(p, q) + bits(q, p)) / 2, 0))

    known = {}
    for lang in {x for x, _ in rows} - {None}:
        texts = [t for x, t in rows if x == lang]
        per_doc, every = Counter(w for t in texts for w in set(words_of(t))), Counter(w for t in texts for w in words_of(t))
        top = sorted(per_doc, key=lambda w: (-per_doc[w], tie(w)))[:common]
        if len(texts) >= least_docs and sum(every.values()) >= least_reference:
            reference = Counter({w: every[w] for w in top})
            reference[None] = sum(every.values()) - sum(reference.values())
            known[lang] = Counter(kind(c) for t in texts for c in t or ""), reference, set(top)
    out = []
    for lang, text in rows:
        kinds, words, far = Counter(kind(c) for c in text or ""), words_of(text), [None, None]
        if lang in known:
            classes, reference, top = known[lang]
            far[0] = apart(kinds, classes) if sum(kinds.values()) >= 300 else None
            far[1] = apart(Counter(w if w in top else None for w in words), reference) if len(words) >= 50 else None
        most = [math.sqrt(m * m + upper / (8 * math.log(2) * max(n, 1))) for m, upper, n in ((0.3, 28.06, sum(kinds.values())), (0.22, 73.49, len(words)))]
        out.append((*far, all(d is None or d <= m for d, m in zip(far, most))))
    return out
