"""Personal data in texts: four fixed formats, and candidates that boosted trees judge.

Only DataFrame functions are used. Generators of high recall propose spans, also overlapping ones: anything like an address, any
row of four or more digits with separators, and groups of digits. Their format and context features go through gradient-boosted
trees of depth two, written out as one SQL expression. The trees learn from lessons whose answer is known: personal data are
finds of the fixed formats in the corpus, rewritten so that the format no longer accepts them (plus removed, ``@`` spelled out, other
separators), and invented numbers and addresses; neutral are dates, versions, amounts and the like, put at the places of other
numbers of the corpus or into invented contexts. Candidates of the corpus that no format proves stay unlabelled. A threshold for
addresses and one for numbers are calibrated on held-out lessons for precision.

Every text gives its lessons. They are counted by their features once; each split of a tree comes from sums by feature and value
over all of them, which Spark makes, so the driver gets some thousands of sums whatever the size of the corpus.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save

_LOCAL = "A-Za-z0-9._%+-"
#: Matches begin where a run begins or the match before has ended, and never give back what they took; so each text is read
#: once, and the matches are those of the plain expressions.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Generators of candidates beside the fixed formats.
GENERATORS = {
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9])[+(]?[0-9](?:[ .()/-]{0,2}[0-9]){3,24}+(?![0-9])",
    "groups": r"(?<![0-9])(?:\([0-9]{2,5}+\) ?+|[0-9]{2,5}+[ ./-])[0-9]{2,4}+(?:[ .-][0-9]{2,4}+){1,3}+(?![0-9])",
}
#: Weight of all lessons of the corpus together, however many there are (less where there are fewer); invented lessons; rounds of
#: boosting, their rate, and the precision that a threshold keeps.
CORPUS, INVENTED, ROUNDS, RATE, PRECISION = 3000, 3000, 40, 0.3, 0.98
#: Parts of one in which sums are kept, so that they are the same in any order; steps of a score in the calibration.
_PARTS, _STEPS = 1 << 24, 1 << 10
#: Counts below this are told apart, larger ones by an eighth of a doubling, so that a feature has a few hundred values at most.
_EXACT = 32
#: Forms of lessons: ``#`` is a digit, ``^`` one from 2 to 9, ``~`` a name of letters.
PERSONAL = ("^##-^##-####", "(^##) ^##-####", "^##.^##.####", "^## ^## ####", "0## #### ####", "0#### ######", "0##-#######", "0## ### ## ##", "0# ## ## ## ##",
            "00^# ### #######", "^##/^##-####", "###-##-####", "1-^##-^##-####", "(0##) #### ####", "0###/######",
            "~(at)~(dot)com", "~ [at] ~.org", "~ (at) ~ (dot) net", "~[at]~[dot]de", "~ @ ~.com", "~.~(at)~.co.uk", "~##[at]~.com", "~ (at) ~.fr", "~(at)~.es")
NEUTRAL = ("19##-0#-1#", "20##-1#-2#", "1#.0#.20##", "2#/0#/19##", "20##/0#/1#", "19##", "20##", "19##-19##", "20##-20##", "(20##", "####", "^####", "^#####", "^#######",
           "^#########", "^############", "^###############", "^.####", "^#.######", "^.##.#.#", "^#.#.####", "1.#.##.#", "^ ### ###", "^## ### ###", "^ ### ### ###",
           "978-#-##-######-#", "978##########", "^##/^##", "^##-^##", "^### - ^###", "##.##.##", "^##.^##.^##", "##-##-##", "^-####-####-#", "10.####/####",
           "20##-0#-1# 1# 0#", "^##.^##.^##.####", "~ @ ^#", "~@^x", "~ @ ~", "~@~", "~(at)^", "~[at]~", "^ @ ^.##", "^## @ ^##", "~ (at) ~", "~ @ ^.##")
PERSONAL_PLACES = ("call ", "phone: ", "my number is ", "tel. ", "", "and ", "reach me on ", "write to ", "contact ", "e-mail: ", "that is ", "the ")
NEUTRAL_PLACES = ("in ", "on ", "page ", "order ", "version ", "", "and ", "total ", "no. ", "from ", "that is ", "the ")
#: Code points of context on each side.
CONTEXT = 24


def matches(text: Column, pattern: str) -> Column:
    """Begin, end (code points) and value of each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,stop:bigint,value:string>>").alias("out"))

    def step(acc, p):
        begin = acc["at"] + p["gap"]
        stop = begin + F.coalesce(F.length(p["value"]), F.lit(0))
        one = F.array(F.struct(begin.alias("begin"), stop.alias("stop"), p["value"].alias("value")))
        return F.struct(stop.alias("at"), F.when(p["value"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), zero, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<begin:bigint,stop:bigint,value:string>>")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a row of digits passes the Luhn check."""
    def part(i):
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_matches(text: Column) -> dict[str, Column]:
    """For each kind, its matches (begin, stop, value) in ``text``; a test that most texts fail comes first."""
    octets = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS["email"])).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), F.filter(matches(text, PATTERNS["ip"]), lambda m: m["value"].rlike(octets))).otherwise(_none()),
        "card": F.when(text.rlike(r"(?:[0-9][ -]?+){12}"), F.filter(matches(text, PATTERNS["card"]), lambda m: luhn(digits(m["value"])))).otherwise(_none()),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(matches(text, PATTERNS["phone"]), lambda m: F.length(digits(m["value"])).between(9, 15))).otherwise(_none()),
    }


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["begin"].alias("begin"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    """Spans (begin, stop, kind) of the fixed formats, by begin and then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate((*KINDS, "likely")) for x in (name, k)])
    every = F.concat(*[_spans(m, k) for k, m in base_matches(text).items()])
    return in_order(every, rank)


def in_order(spans: Column, rank: Column | None = None) -> Column:
    rank = F.create_map(*[F.lit(x) for k, name in enumerate((*KINDS, "likely")) for x in (name, k)]) if rank is None else rank
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["begin"].alias("begin"), s["stop"].alias("stop"), s["kind"].alias("kind")))


#: Words around a candidate that say what it is.
_ABOUT = {"about_phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|whatsapp)", "about_card": r"(?i)\b(?:card|visa|mastercard|amex|iban|account|payment|cvv)",
          "about_mail": r"(?i)\b(?:e-?mail|write|contact|reach)", "about_person": r"(?i)\b(?:ssn|passport|born|name|address|id)\b"}


def features(text: Column, c: Column) -> dict[str, Column]:
    """Format and context of one candidate. What a fixed format is decided by (sum check, leading plus) is left out, so that the
    trees must go by the rest."""
    v, only = c["value"], digits(c["value"])
    runs = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(runs, lambda g: F.length(g))
    low = F.greatest(c["begin"] - CONTEXT, F.lit(0))
    before = F.substr(text, low.cast("int") + 1, (c["begin"] - low).cast("int"))
    after = F.substr(text, c["stop"].cast("int") + 1, F.lit(CONTEXT))
    count = lambda pattern: F.length(v) - F.length(F.regexp_replace(v, pattern, ""))
    out = {"length": F.length(v), "digits": F.length(only), "dots": count(r"\."), "dashes": count("-"), "spaces": count(" "), "brackets": count("[()]"),
           "slashes": count("/"), "letters": count("[A-Za-z]"), "address": v.rlike(r"@|[(\[]at[)\]]"), "dotted": v.rlike(r"[(\[]dot[)\]]"), "at": count("@"), "groups": F.size(runs),
           "longest": F.array_max(sizes), "first": F.get(sizes, F.lit(0)), "second": F.get(sizes, F.lit(1)), "last": F.get(sizes, F.size(runs) - 1),
           "year": v.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])"), "ending": F.length(F.regexp_extract(v, r"([A-Za-z]*)$", 1)),
           "zero": v.startswith("0"), "glued": before.rlike(r"[A-Za-z0-9._/=-]$"), "followed": after.rlike(r"^[A-Za-z0-9_/=-]")}
    out |= {k: before.rlike(p) for k, p in _ABOUT.items()}
    return {k: _coarse(F.coalesce(x.cast("double"), F.lit(0.0))) for k, x in out.items()}


def _coarse(x: Column) -> Column:
    return F.when(x < _EXACT, x).otherwise(_EXACT + F.floor(F.log2(x / _EXACT) * 8)).cast("double")


FEATURES = ("length", "digits", "dots", "dashes", "spaces", "brackets", "slashes", "letters", "address", "dotted", "at", "groups", "longest", "first", "second", "last", "year", "ending", "zero", "glued", "followed", *_ABOUT)


def candidates(text: Column) -> Column:
    """All candidates with their features, from all generators; they may overlap."""
    numbers = F.concat(matches(text, GENERATORS["number"]), matches(text, GENERATORS["groups"]))
    found = F.concat(F.when(text.rlike(r"@|[(\[]at[)\]]"), matches(text, GENERATORS["address"])).otherwise(_none()),
                     F.when(text.rlike(r"(?:[0-9][ .()/-]{0,2}){4}"), F.array_distinct(numbers)).otherwise(_none()))
    return F.transform(found, lambda c: F.struct(c["begin"].alias("begin"), c["stop"].alias("stop"), *[x.alias(k) for k, x in features(text, c).items()]))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["begin"] < b["stop"]) & (b["begin"] < a["stop"])


def _best_split(sums: list) -> tuple[float, int, float] | None:
    """Gain, feature and cut of the best split of the lessons of one node; ``sums`` has (feature, value, residual, weight, mass), a
    row for each value of each feature."""
    best = None
    for k in range(len(FEATURES)):
        rows = np.array(sorted((r.value, r.residual, r.weight, r.mass) for r in sums if r.feature == k), float).reshape(-1, 4)
        below = np.cumsum(rows[:, 1:], 0)
        if len(rows) < 2:
            continue
        (g, h, n), (total, mass, every) = below[:-1].T / _PARTS, below[-1] / _PARTS
        gain = g * g / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total * total / (mass + 1)
        gain[(n < 4) | (every - n < 4)] = 0
        i = int(gain.argmax())
        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
            best = float(gain[i]), k, float((rows[i, 0] + rows[i + 1, 0]) / 2)
    return best


def _leaf_value(sums: list) -> float:
    one = [r for r in sums if r.feature == 0]
    return float(RATE * sum(r.residual for r in one) / (sum(r.weight for r in one) + _PARTS))


def _score(start: float, trees: list) -> str:
    """SQL of the score of ``x``, an array of features. Trees are an array, so that no code is made for each of them."""
    def side(tree):
        return tree if isinstance(tree, tuple) else (0, 0.0, tree, tree)

    def leaf(i):
        return f"if(x[int(t[{i}])] <= t[{i + 1}], t[{i + 2}], t[{i + 3}])"

    rows = [", ".join(f"{float(v)!r}D" for v in (k, cut, *side(low), *side(high))) for k, cut, low, high in trees]
    made = ", ".join(f"array({r})" for r in rows)
    return f"aggregate(array({made}), {start!r}D, (acc, t) -> acc + if(x[int(t[0])] <= t[1], {leaf(2)}, {leaf(6)}))" if rows else f"{start!r}D"


def boost(lessons: DataFrame) -> tuple[float, list]:
    """Gradient boosting of trees of depth two on the log-odds: the start, and trees (feature, cut, low side, high side).

    ``lessons`` has ``x``, an array of features, ``y`` and ``mass``, and is read twice for each tree.
    """
    both = lessons.agg(F.sum(F.col("y") * F.round(F.col("mass") * _PARTS).cast("bigint")).alias("ones"), F.sum(F.round(F.col("mass") * _PARTS).cast("bigint")).alias("all")).first()
    ones, every = float(both["ones"] or 0) / _PARTS, float(both["all"] or 0) / _PARTS
    start, trees = float(np.log((ones + 1) / (every - ones + 1))), []

    def sums(node: Column) -> dict[bool, list]:
        part = lambda c: f"bigint(round(mass * {c} * {_PARTS}))"
        told = lessons.select("x", "y", "mass", node.alias("node"), F.expr(f"1 / (1 + exp(-({_score(start, trees)})))").alias("p")).selectExpr(
            "node", f"{part('(y - p)')} as r", f"{part('p * (1 - p)')} as w", f"{part('1D')} as m", "posexplode(x) as (feature, value)")
        out = {True: [], False: []}
        for r in told.groupBy("node", "feature", "value").agg(F.sum("r").alias("residual"), F.sum("w").alias("weight"), F.sum("m").alias("mass")).collect():
            out[r.node].append(r)
        return out

    for _ in range(ROUNDS):
        root = sums(F.lit(True))[True]
        split = _best_split(root)
        if split is None:
            trees.append((0, 0.0, _leaf_value(root), _leaf_value(root)))
            continue
        _, k, cut = split
        sides = []
        for low, rows in sorted(sums(F.get("x", F.lit(k)) <= cut).items(), reverse=True):
            inner = _best_split(rows)
            if inner is None:
                sides.append(_leaf_value(rows))
            else:
                at = lambda below: [r for r in rows if r.feature == inner[1] and (r.value <= inner[2]) == below]  # noqa: B023, E731
                sides.append((inner[1], inner[2], *[float(RATE * sum(r.residual for r in at(b)) / (sum(r.weight for r in at(b)) + _PARTS)) for b in (True, False)]))
        trees.append((k, cut, *sides))
    return start, trees


def as_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(c[FEATURES[tree[0]]] <= tree[1], as_column(tree[2], c)).otherwise(as_column(tree[3], c))


def _pick(choices, key: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in choices]), F.pmod(key, F.lit(len(choices))).cast("int"))


def _name(*key: Column) -> Column:
    """Three to ten letters that depend on ``key``."""
    return F.translate(F.substr(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), F.lit(1), F.pmod(F.xxhash64(*key, F.lit("n")), F.lit(8)).cast("int") + 3),
                       "0123456789", "ghijklmnop")


def filled(form: Column, key: Column) -> Column:
    """``form`` with digits and names that depend on ``key``."""
    def sign(c, i):
        h = F.xxhash64(key, i)
        return (F.when(c == "#", F.pmod(h, F.lit(10)).cast("string")).when(c == "^", (F.pmod(h, F.lit(8)) + 2).cast("string")).when(c == "~", _name(key, i)).otherwise(c))

    return F.array_join(F.transform(F.split(form, ""), sign), "")


def _lesson(before: Column, value: Column, after: Column, y: int) -> Column:
    return F.struct(F.concat(before, value, after).alias("text"), F.length(before).cast("bigint").alias("begin"),
                    (F.length(before) + F.length(value)).cast("bigint").alias("stop"), F.lit(float(y)).alias("y"))


def invented(spark: SparkSession) -> DataFrame:
    """Lessons (text, begin, stop, y) that need no corpus, half of them personal; so both answers are always there."""
    key, side = F.xxhash64("id"), F.xxhash64("id", F.lit("place"))
    both = []
    for y, forms, places in ((1, PERSONAL, PERSONAL_PLACES), (0, NEUTRAL, NEUTRAL_PLACES)):
        before = F.concat(F.lit("some words "), _pick(places, side))
        both.append(_lesson(before, filled(_pick(forms, F.col("id")), key), _pick((" and more.", ", then", ".", ""), F.xxhash64("id", F.lit("after"))), y))
    return spark.range(INVENTED // 2).select(F.explode(F.array(*both)).alias("l")).select("l.*")


def rewritten(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Lessons of the corpus: finds of the fixed formats in forms that these refuse, and neutral forms at places of other numbers."""
    t = F.col(text)
    around = lambda m: (F.substr(t, F.greatest(m["begin"] - 2 * CONTEXT, F.lit(0)).cast("int") + 1, F.least(m["begin"], F.lit(2 * CONTEXT)).cast("int")),
                        F.substr(t, m["stop"].cast("int") + 1, F.lit(2 * CONTEXT)))

    def lessons(found, value, y):
        def one(m):
            before, after = around(m)
            return _lesson(before, value(m, F.xxhash64(t, m["begin"])), after, y)
        return F.transform(found, one)

    def spelled(m, key):
        host = F.substring_index(m["value"], "@", -1)
        return F.concat(F.substring_index(m["value"], "@", 1), _pick(("(at)", " [at] ", " (at) ", "[at]", " @ "), key),
                        F.when(F.pmod(key, F.lit(3)) == 0, F.regexp_replace(host, r"\.", "(dot)")).otherwise(host))

    def regrouped(m, key):
        return F.regexp_replace(digits(m["value"]), "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), _pick((".", "/", "  "), key)))

    base = base_matches(t)
    proven = F.concat(*[_spans(m, k) for k, m in base.items()])
    others = F.filter(F.when(t.rlike(r"(?:[0-9][ .()/-]{0,2}){4}"), matches(t, GENERATORS["number"])).otherwise(_none()), lambda c: ~F.exists(proven, lambda b: _overlaps(b, c)))
    every = F.concat(lessons(base["phone"], lambda m, key: F.substr(m["value"], F.lit(2)), 1), lessons(base["email"], spelled, 1), lessons(base["card"], regrouped, 1),
                     lessons(F.concat(others, base["ip"]), lambda m, key: filled(_pick(NEUTRAL[:NEUTRAL.index("~ @ ^#")], key), key), 0))
    return docs.select(F.explode(every).alias("l")).select("l.*")


def lessons_by_features(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The lessons of all texts and the invented ones, by features ``x`` and answer ``y``: ``n`` of the corpus, ``own`` invented."""
    chosen = docs.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    asked = lambda given, corpus: (given.withColumn("_c", candidates(F.col("text"))).select("y", F.explode(F.filter("_c", lambda c: (c["begin"] == F.col("begin")) & (
        c["stop"] == F.col("stop")))).alias("c")).select(F.lit(corpus).alias("corpus"), F.array(*[F.col("c")[k] for k in FEATURES]).alias("x"), "y"))
    every = asked(rewritten(chosen, text="_t"), True).unionByName(asked(invented(docs.sparkSession), False))
    return every.groupBy("x", "y").agg(F.count_if("corpus").alias("n"), F.count_if(~F.col("corpus")).alias("own"))


def fit(docs: DataFrame, *, text: str = "text") -> tuple[float, list, tuple[float, float]]:
    """Start, trees, and the thresholds of numbers and of addresses, from the lessons of all texts.

    Lessons of the corpus weigh ``CORPUS`` in all, so that the invented ones, with forms that a corpus may lack, count beside them.
    Lessons with the same features are either learnt from or held out. Where no threshold keeps the precision, the one above all
    neutral held-out lessons is taken.
    """
    counted = save(lessons_by_features(docs, text=text))
    share = min(1.0, CORPUS / max(1, counted.agg(F.sum("n")).first()[0] or 0))
    mass = F.col("own") + F.col("n") * share
    lessons = counted.select("x", "y", mass.alias("mass"), (F.pmod(F.xxhash64("x"), F.lit(4)) == 0).alias("held_out"))
    start, trees = boost(lessons.where(~F.col("held_out")))
    step = F.floor(F.expr(_score(start, trees)) * _STEPS)
    tested = lessons.where("held_out").groupBy((F.get("x", F.lit(FEATURES.index("address"))) > 0).alias("address"), step.alias("step")).agg(
        *[F.sum(F.when(F.col("y") == y, F.round(F.col("mass") * _PARTS).cast("bigint")).otherwise(0)).alias(c) for c, y in (("zeros", 0.0), ("ones", 1.0))]).collect()
    return start, trees, tuple(_step_threshold([r for r in tested if r.address == side]) for side in (False, True))


def _step_threshold(steps: list) -> float:
    """The threshold of scores in steps (step, zeros, ones), which hold all from the step on up to the next."""
    rows = [(r.step, y, n) for r in steps for y, n in ((0, r.zeros), (1, r.ones)) if n]
    at, y, n = np.array(rows, float).reshape(-1, 3).T
    return float(np.ceil(threshold(at, y, n))) / _STEPS


def threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The lowest score from which on the share of ones is at least ``PRECISION``."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-score, kind="stable")
    every = np.cumsum(weight[order])
    right = np.cumsum((weight * y)[order])
    good = np.flatnonzero((right >= PRECISION * every) & (every > 0) & (np.append(np.diff(score[order]), -1) < 0))
    return float(score[order][good[-1]]) if len(good) else float(np.nextafter(score[y == 0].max(initial=0.0), np.inf))


def find_private(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and spans (begin, stop, kind) in code points, by begin and then by kind.

    Spans of the fixed formats are all there; candidates that the trees accept and that touch none of them are of kind
    ``likely``; these may overlap. Null and empty texts have none.
    """
    start, trees, (number, address) = fit(docs, text=text)
    body = F.coalesce(F.col(text), F.lit(""))
    made = docs.drop("spans").withColumn("_base", base_spans(body))
    score = lambda c: functools.reduce(operator.add, [as_column(t, c) for t in trees], F.lit(start))
    made = made.withColumn("_more", F.filter(candidates(body), lambda c: ~F.exists("_base", lambda b: _overlaps(b, c))))
    made = made.withColumn("_more", F.when(F.size("_more") > 0, F.filter("_more", lambda c: score(c) >= F.when(c["address"] > 0, address).otherwise(number))).otherwise(F.col("_more")))
    return made.withColumn("spans", in_order(F.concat("_base", _spans(F.col("_more"), "likely")))).drop("_base", "_more")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents, with their columns, with each span replaced by its kind in brackets; of overlapping ones the first counts."""
    own = [F.col("spans").alias("_own")] if "spans" in docs.columns else []
    found = find_private(docs.select("*", *own), text=text)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col(text), acc["at"].cast("int") + 1, (s["begin"] - acc["at"]).cast("int"))
        return F.when(s["begin"] < acc["at"], F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["stop"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")))

    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), acc["at"].cast("int") + 1)))
    return found.withColumn(text, clean).select(*[F.col("_own").alias(c) if own and c == "spans" else F.col(c) for c in docs.columns])
