"""The queries against plain versions, on whole tables and on odd rows."""

import random

import pytest

from sourcesweep.llm import bpe, chat, decontamination, near_dedup, quality, secrets, substrings
from sourcesweep.llm.queries import QUERIES, tokenizer_path

from . import brute
from .conftest import rows_of


def got(spark, name, folder, *columns):
    df = next(f for k, f in QUERIES.items() if k.startswith(name + "_"))(spark, folder)
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()} if columns else df


def test_secrets(spark, folder):
    found = got(spark, "op1", folder, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for d, text in rows_of(folder, "documents", "doc_id", "text"):
        want = brute.secrets_base(text)
        n = [sum(k == x for _, _, x in want) for k in ("assign", "access", "hex")]
        assert found[d][:4] == (*n, brute.sha(brute.named(want))), (d, text[:200])
        kept = [x for x in found[d][4].split(",") if x and not x.startswith("random:")]
        assert ",".join(kept) == brute.named(want)


def test_contamination(spark, folder):
    docs = rows_of(folder, "documents", "doc_id", "text")
    want = brute.contamination(docs, rows_of(folder, "benchmark", "item_id", "text"))
    assert got(spark, "op2", folder, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_near_duplicates(spark, folder):
    want = brute.near(rows_of(folder, "documents", "doc_id", "text"))
    assert got(spark, "op3", folder, "doc_id", "n_shingles", "component_id", "kept") == want


def test_passages(spark, folder):
    want = brute.passages(rows_of(folder, "documents", "doc_id", "text"))
    assert got(spark, "op4", folder, "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_bpe_of_parts_in_parallel(spark, nasty):
    """Long texts as rows of parts: the ids of the library, one row for each row, repeated and null ids included."""
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = [t for _, t in rows_of(nasty, "documents", "doc_id", "text")]
    rows = [(None if k % 9 == 0 else k % 40, t, k) for k, t in enumerate([*texts, *texts[:30]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(5)
    want = sorted((d if d is not None else -1, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for d, t, _ in rows)
    for part in (150, 5000):
        got = bpe.encode(docs, tokenizer_path(), back=True, part=part).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in got) == want
        assert sorted(r.decoded for r in got) == sorted(t or "" for _, t, _ in rows) and all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_bpe(spark, folder):
    import numpy as np
    from tokenizers import Tokenizer

    of, want = Tokenizer.from_file(tokenizer_path()), {}
    for d, text in rows_of(folder, "documents", "doc_id", "text"):
        ids = of.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(of.decode(ids, skip_special_tokens=False)))
    assert got(spark, "op5", folder, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_chats(spark, folder):
    said = "\\### Assistant: </turn> ok"
    want = brute.chats([*rows_of(folder, "conversations", "conv_id", "turn", "role", "text"), (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got(spark, "op6", folder, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want


@pytest.mark.parametrize("name", [k.split("_")[0] for k in QUERIES if k not in ("pipeline", "op9_toxicity")])
def test_empty_tables(spark, empty, name):
    assert got(spark, name, empty).count() == (1 if name == "op6" else 0)


def test_tree_concatenation_small_leaves():
    """Cuts at all kinds of places, also inside runs without any piece start."""
    import random

    from tokenizers import Tokenizer

    of, library = bpe.Codec(tokenizer_path(), leaf=40, reach=24), Tokenizer.from_file(tokenizer_path())
    r = random.Random(1)
    kinds = ["abcdefgh", "0123456789", " \n\t", "'!?.-", "éß漢🙂", "the of ", "'s 'll 're", "<|endoftext|>"]
    for k in range(300):
        parts = ["".join(r.choice(r.choice(kinds)) for _ in range(r.randrange(1, 200))) if r.random() < 0.6 else r.choice(kinds) * r.randrange(1, 30) for _ in range(8)]
        text = "".join(parts)
        assert [t[0] for t in of.tree(text)] == library.encode(text, add_special_tokens=False).ids, text
        assert of.decode(of.encode(text)) == text
        cuts = bpe.halves(len(text), 70)  # the same with parts that are joined from left to right
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        assert of.joined(pieces, [of.encode(x) for x in pieces]).tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in (" " * 90001, "!" * 50000 + "\n" * 50000, "ab" * 40000 + " x", "<|endoftext|>" * 5000):
        assert of.encode(text).tolist() == bpe.Codec(tokenizer_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cover_has_every_difference():
    for period, cover in ((substrings.PERIOD, substrings.COVER),):
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.anchor_length(50, 31) == 20
    with pytest.raises(ValueError):
        substrings.anchor_length(30, 31)


def test_benchmark_in_blocks(spark, nasty):
    """A benchmark beyond one block takes more passes and gives the same."""
    docs, bench = spark.read.parquet(f"{nasty}/documents.parquet"), spark.read.parquet(f"{nasty}/benchmark.parquet")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    one = decontamination.find_contamination(docs.select("doc_id", "text"), bench).orderBy("doc_id").collect()
    many = decontamination.find_contamination(docs.select("doc_id", "text"), bench, block_bytes=60).orderBy("doc_id").collect()
    same = [c for c in one[0].asDict() if c not in ("longest_item", "longest_at")]
    assert [[r[c] for c in same] for r in one] == [[r[c] for c in same] for r in many]
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    hit = {r["doc_id"] for r in one if r["hit_spans"]}
    assert {r["doc_id"]: r["items"] for r in clean.collect()} == {k: k for k in range(docs.count()) if k not in hit}


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m y"), (2, "a b c d e f g h i j k a b"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "A b-c d e f g h i j k l m n")], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench).collect()}
    assert (rows[1]["longest"], rows[1]["longest_item"], rows[1]["longest_at"], rows[1]["hit_spans"]) == (13, "q", 1, [1, 14])
    assert (rows[2]["longest"], rows[2]["hit_spans"], rows[3]["longest"], rows[3]["hit_spans"]) == (11, [0, 11], 0, [])


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101), (5, 5)]
    found = {r[0]: r[1] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e", "z"), (1, "a b c d e", "z"), (2, "A b c d E", "y"), (None, "a b c d e", "x"), (3, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id is null or doc_id <> 2").collect()))


def test_randomness_battery_tells_keys_from_words(spark):
    import random

    r = random.Random(2)
    keys = ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(200)]
    other = [f"chapter-{k}-of-the-{k % 9}-long-title-about-things" for k in range(200)] + ["zq1" * 12] * 50 + ["Q" * 30 + "7"] * 50
    docs = spark.createDataFrame([(k, f"see {x} there") for k, x in enumerate(keys + other)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs).collect()}
    assert sum(bool(found[k]) for k in range(200)) >= 190
    assert sum(bool(found[k]) for k in range(200, 500)) <= 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[300] == f"see {other[100]} there" and sum(clean[k] == "see <SECRET> there" for k in range(200)) >= 190


def test_keys_glued_to_names_urls_and_paths(spark):
    import random
    import string

    r = random.Random(4)
    mixed = string.ascii_letters + string.digits
    forms = {"AWS_KEY={}": mixed, "x private_key={}== y": mixed + "+/", "https://a.example/get?user=7&sig={}&x=1": mixed + "-_",
             "see /v1_x/{} there": mixed, "a-b/{}": mixed + "-_", "only {} small": string.ascii_lowercase, "only {} CAPITALS": string.ascii_uppercase}
    keys = [(form, "".join(r.choices(signs, k=40))) for form, signs in forms.items() for _ in range(100)]
    other = [f"NAME=chapter-{k}-of-the-long/title_about/things" for k in range(200)] + ["see internationalisierungsgedanken there", "MISUNDERSTANDINGSANDOTHERS ="] * 50
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([form.format(key) for form, key in keys] + other)], "doc_id long, text string")
    found = {x["doc_id"]: x["spans"] for x in secrets.find_secrets(docs).collect()}
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}
    for n, form in enumerate(forms):
        assert sum(any(s["begin"] <= form.index("{") + 2 and s["stop"] >= form.index("{") + 38 for s in found[k]) for k in range(100 * n, 100 * n + 100)) >= 85, form
        assert sum(keys[k][1] not in clean[k] for k in range(100 * n, 100 * n + 100)) >= 90, form
    assert not any(found[k] for k in range(len(keys), len(keys) + len(other)))


def test_false_share_of_secrets():
    """Values of simulated keys follow the histogram, and ids among keys don't hide behind too many estimated keys."""
    import numpy as np

    rng = np.random.default_rng(8)
    for name, size, n in (("base62", 3, 40), ("hex", 2, 32), ("base64url", 3, 43), ("lower", 0, 22)):
        x = rng.integers(0, len(secrets._CELLS[name]), (20_000, n))
        share = np.bincount([secrets._bin(p) for p in secrets.combined(secrets.p_values(x, name))], minlength=secrets.BINS) / len(x)
        keys = secrets.key_bins(name, size)
        assert abs(share[50:].sum() - keys[50:].sum()) < 0.03 and abs(share[5:].sum() - keys[5:].sum()) < 0.02, name
    # ids with many digits: with 16 % too many keys estimated, 5 % of what is accepted are ids; now the rate and a standard error
    rng = np.random.default_rng(8)
    signs = dict(secrets.ENCODINGS)["base62"]
    made = ["".join(signs[c] for c in row) for row in rng.integers(0, 62, (3000, 40))]
    ids = ["".join(signs[c] for c in rng.choice(62, 40, p=np.where(np.arange(62) < 10, 2.8, 34 / 52) / 62)) for _ in range(1500)]
    bins = [[secrets._bin(secrets.randomness(v, "base62")) for v in values] for values in (made, ids)]
    count = [np.bincount(b, minlength=secrets.BINS) for b in bins]
    cut = secrets.least_bin(count[0] + count[1], secrets.RATE, secrets.key_bins("base62", 3))
    assert count[1][cut:].sum() <= 0.03 * (count[0] + count[1])[cut:].sum() and count[0][cut:].sum() >= 0.9 * 3000


def test_turn_order(spark):
    rows = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (4, 0, "user"), (4, 1, "user"), (4, 2, "assistant")]
    made = chat.format_conversations(spark.createDataFrame([(*x, "t") for x in rows], "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: (r["valid"], r["wrong_turn"]) for r in made.collect()} == {1: (True, None), 2: (False, 0), 3: (False, None), 4: (False, 1)}


def test_private(spark, folder):
    found = got(spark, "op7", folder, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for d, text in rows_of(folder, "documents", "doc_id", "text"):
        want = brute.private(text)
        n = [sum(k == x for _, _, x in want) for k in ("email", "ip", "card", "phone")]
        assert found[d][:5] == (*n, brute.sha(brute.named(want))), (d, want, found[d], text[:300])
        assert ",".join(x for x in found[d][5].split(",") if x and not x.startswith("likely:")) == brute.named(want)


def test_quality(spark, folder):
    found = got(spark, "op8", folder, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, text in rows_of(folder, "documents", "doc_id", "text"):
        want = brute.quality(text)
        assert found[d][:6] == want, (d, text)
        assert not (found[d][5] and found[d][6])


def test_divergence_of_quality(spark, folder):
    rows = rows_of(folder, "documents", "doc_id", "lang", "text")
    found = {r["doc_id"]: r for r in QUERIES["op8_quality_rules"](spark, folder).collect()}
    for (d, _, text), (kinds, words, fine) in zip(rows, brute.divergences([r[1:] for r in rows])):
        r = found[d]
        assert (r["class_distance"] is None, r["word_distance"] is None) == (kinds is None, words is None), (d, text)
        assert abs((r["class_distance"] or 0) - (kinds or 0)) < 1e-9 and abs((r["word_distance"] or 0) - (words or 0)) < 1e-9, (d, text)
        assert r["kept"] == (fine and not r["base_failed"])


def test_quality_of_any_language(spark):
    """Texts of every language stay, also in other scripts; those of another language or script than they say, and lists of rare words, go."""
    r = random.Random(9)
    letters = {"it": "abcdefgilmnoprstuvz", "ru": "абвгдежзиклмнопрстуфхцчшя", "el": "αβγδεζηθικλμνξοπρστυ", "pl": "abcdeęfghijklłmnoóprsśtuwyzż", "zz": "qwxyk"}
    words = {x: ["".join(r.choices(s, k=r.randrange(1, 4))) for _ in range(30)] + ["".join(r.choices(s, k=r.randrange(5, 10))) for _ in range(900)] for x, s in letters.items()}
    say = lambda x, n: " ".join(r.choice(words[x][:30] if r.random() < 0.45 else words[x][30:]) + ("." if r.random() < 0.1 else "") for _ in range(n))
    good = [(x, say(x, r.choice([60, 150, 171, 400, 900]))) for x in letters for _ in range(60 if x != "zz" else 4)] + [(None, say("it", 200)), (None, None), ("it", "")]
    bad = [("ru", say("el", 300)), ("it", say("ru", 200)), ("pl", say("it", 300)), ("it", " ".join(r.sample(words["it"][30:], 400)))]
    docs = spark.createDataFrame([(k, x, t, "x") for k, (x, t) in enumerate(good + bad)], "doc_id int, lang string, text string, kept string").repartition(3)
    found = {q["doc_id"]: q["kept"] for q in quality.judge(docs).collect()}
    assert [k for k, (_, t) in enumerate(good) if found[k] != bool(t)] == []
    assert not any(found[len(good) + k] for k in range(len(bad)))
