"""Exact duplicates, the audit of sources and the draw against plain versions, on whole tables and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sourcesweep.llm import divergence, exact_dedup, quality, resampling
from sourcesweep.llm.queries import QUERIES

from .brute import LETTERS, lower, sha
from .conftest import rows_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_of(docs):
    """Rows (lang, source, part, item, value, rank) of rows (id, lang, source, text)."""
    counts, within, out = defaultdict(Counter), defaultdict(Counter), []
    for _, lang, source, text in docs:
        terms = TERM.findall(lower(text))
        counts[lang or "", source or ""].update(terms)
        within[lang or ""].update(set(terms))
    for lang in within:
        kept = [t for t, n in within[lang].items() if n >= 3]
        own = {s: c for (x, s), c in counts.items() if x == lang}
        own[None] = sum(own.values(), Counter())

        def prices(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        price = {s: prices(c) for s, c in own.items()}
        f = lambda p, q: (p - q) ** 2 // q
        for s in own.keys() - {None}:
            pairs = [(o, sum(f(price[s][t], price[o][t]) for t in kept)) for o in own if o not in (s, None)]
            terms = [(t, f(price[s][t], price[None][t])) for t in kept if own[s][t] and price[s][t] > price[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def draw_of(docs, target, buckets=10_000, percent=25):
    def found(text):
        w = LETTERS.findall(lower(text))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in itertools.pairwise(w)]]

    own = {d: found(t) for d, t in docs}
    s, t = (Counter(b for _, x in some for b in x) for some in (own.values(), [found(x) for x in target]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = {}
    for d, (n, x) in own.items():
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((d for d in own if own[d][0] >= 20), key=lambda d: (-out[d][2], d))
    for k, d in enumerate(order[:percent * len(order) // 100], 1):
        out[d][3] = k
    return {d: tuple(x) for d, x in out.items()}


def test_exact_duplicates(spark, folder):
    groups = defaultdict(list)
    for d, text in rows_of(folder, "documents", "doc_id", "text"):
        groups[lower(text)].append(d)
    want = {d: (max(g), len(g), d == max(g), sha(t)) for t, g in groups.items() for d in g}
    found = QUERIES["op13_exact_dedup"](spark, folder)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == want


def test_exact_duplicates_with_repeated_and_missing_ids(spark):
    rows = [(1, "a", 0), (1, "A", 1), (None, "a", 2), (None, "b", 3), (None, "B", 4), (2, None, 5), (3, "", 6), (4, "c", 7), (4, "d", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found) == 5  # a, b, empty, c, d
    by = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found)
    assert by == {(1, 1, 3): 2, (None, 1, 3): 1, (None, None, 2): 2, (2, 3, 2): 1, (3, 3, 2): 1, (4, 4, 1): 2}
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["kept"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_texts_do_not_travel_to_meet_their_bitmap(spark):
    docs = spark.createDataFrame([(k, f"t{k % 7}") for k in range(50)], "doc_id long, text string").repartition(5)
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan, plan


@pytest.mark.parametrize("spread", [1, 10, 1000, 10 ** 9])
def test_golomb_code(spread):
    r = np.random.default_rng(spread)
    for n in (0, 1, 2, 7, 500):
        values = np.unique(r.integers(0, spread * (n + 1), n).astype(np.uint64)) + np.uint64(12)
        k, code = exact_dedup.golomb(exact_dedup.gaps_of(values, 12))
        assert (exact_dedup.values_of(exact_dedup.ungolomb(code, len(values), k), 12) == values).all()
    assert len(code) * 8 <= len(values) * (math.log2(spread + 1) + 3) + 8


def test_audit(spark, folder):
    found = QUERIES["op11_source_divergence"](spark, folder)
    assert sorted(map(tuple, found.collect())) == audit_of(rows_of(folder, "documents", "doc_id", "lang", "source", "text"))


def test_audit_of_many_groups_and_few_terms(spark):
    """More groups than a block holds, groups and languages without kept terms, and a language of one source."""
    r = random.Random(3)
    rows = [(k, r.choice(["x", "x", "x", None]), f"s{r.randrange(75)}", " ".join(f"w{'abcdefghij'[r.randrange(10)] * r.randrange(1, 4)}" for _ in range(r.randrange(4)))) for k in range(400)]
    rows += [(900, "none", "a", "once"), (901, "none", "b", "twice"), (902, "one", "a", "p"), (903, "one", "a", "p"), (904, "one", "a", "P q"), (905, "x", "empty", "")]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, lang string, source string, text string, n int, p int")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == audit_of(rows)


@pytest.mark.parametrize("step", [3, 1 << 17])
def test_joint_walk_equals_all_cells(monkeypatch, step):
    monkeypatch.setattr(divergence, "STEP", step)
    r = np.random.default_rng(5)
    for height_a, height_b, width, full in ((1, 1, 1, 0.5), (5, 3, 9, 0.3), (4, 4, 33, 0.02), (7, 2, 16, 1.0), (3, 6, 40, 0.0)):
        for same in (False, True):
            tables = [np.where(r.random((h, width)) < full, r.integers(1, 10 ** 9, (h, width)), 0) for h in (height_a, height_b)]
            bases = [r.integers(1, 1000, h) for h in (height_a, height_b)]
            if same:
                tables[1], bases[1] = tables[0], bases[0]
            levels = max(1, int(max(height_a, height_b, width) - 1).bit_length())
            trees = [divergence.Tree(*np.nonzero(t), t[np.nonzero(t)], levels) for t in tables]
            there, back = divergence.joint(*trees, *bases, width, levels, same)
            p, q = (np.where(t > 0, t, b[:, None]) for t, b in zip(tables, bases))
            for i in range(len(p)):
                for j in range(i + 1 if same else 0, len(q)):
                    assert there[i, j] == ((p[i] - q[j]) ** 2 // q[j]).sum() and back[i, j] == ((p[i] - q[j]) ** 2 // p[i]).sum()


def test_draw(spark, folder):
    want = draw_of(rows_of(folder, "documents", "doc_id", "text"), [t for t, in rows_of(folder, "benchmark", "text")])
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op12_importance_resampling"](spark, folder).collect()} == want


def test_draw_of_repeated_and_missing_ids(spark):
    rows = [(k % 9 or None, " ".join(["a", "b"] * 10), k) for k in range(40)] + [(77, None, 40), (78, "short", 41)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(3), spark.createDataFrame([("a b", 1)], "text string, doc_id int")
    found = resampling.importance(docs, target, percent=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))
    assert {r["rank"] for r in found if r["doc_id"] in (77, 78)} == {None}
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert all(a["score"] >= b["score"] for a, b in itertools.pairwise(ranked))
    drawn = resampling.resample(docs, target, percent=50)
    assert drawn.columns == docs.columns and {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in ranked} - {None}
    none = resampling.importance(docs, target.where("false")).collect()
    assert len(none) == len(rows)


def test_crc_by_position_table():
    r = random.Random(1)
    texts = ["", "x" * 70000 + " y " + "z" * 64 + " " + "w" * 63 + " " + "v" * 65, "é漢 a", "a", " - "]
    texts += ["".join(r.choice(["ab" * r.randrange(1, 40), " ", "é", "Z", "9", "-"]) for _ in range(60)) for _ in range(200)]
    raw = [t.encode() for t in texts]
    words, pairs, at = resampling.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    pair_at = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - 1, 0))])
    for k, text in enumerate(texts):
        w = LETTERS.findall(lower(text))
        assert words[at[k]:at[k + 1]].tolist() == [zlib.crc32(x.encode()) for x in w]
        assert pairs[pair_at[k]:pair_at[k + 1]].tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in itertools.pairwise(w)]
    assert resampling._constant(3 << 20) == zlib.crc32(bytes(3 << 20))


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling", "op13_exact_dedup"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_a_language_keeps_its_reference_among_many_documents(spark):
    """Documents of other languages don't decide whether a language has a reference."""
    few = spark.range(10).selectExpr("'xx' as lang", "repeat('lorem ipsum dolor ', 100) as text")
    many = spark.range(110_000).selectExpr("'en' as lang", "'a b' as text")
    assert quality.references(few).languages == ["xx"]
    assert quality.references(few.unionByName(many)).languages == ["en", "xx"]
