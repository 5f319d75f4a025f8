"""How far the sources of a language differ in their words: a K-squared tree over the matrix of groups and terms.

Rows of the matrix are the groups (lang, source), columns the kept terms of the language. Spark counts the cells that are not zero; a
tile, the cells of a block of terms for one or two blocks of groups, becomes K-squared trees (K = 2): bits for each quadrant that is
not empty, level by level. Pairs of groups are walked down two trees at once. Where the quadrants of both are empty, all cells have the
price that two counts of zero have, so the quadrant's width is all that is noted; only where one of them holds a cell does the walk go on,
down to the cells. Terms that no group of a tile has are priced in the same way, by their number, after the tiles are summed.

No cell is written more often than there are blocks of ``GROUPS`` groups in its language, and the result has a row for each pair of
groups of a language, as an audit of all pairs must.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import map_rows, text_buffers
from .store import save

#: Documents of a language that a term must be in, and how many terms a group lists.
DOCUMENTS, LISTED = 3, 200
SCALE = 1_000_000_000
#: Sides of a tile: groups of a block, and terms on average.
GROUPS, TERMS = 32, 4096
#: Pairs of quadrants that are walked at once.
STEP = 1 << 17

_TERM = np.array([c >= 128 or chr(c).isalpha() and c < 128 for c in range(256)])


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that hold the term, of parts of the input; a row with a null term for each group."""
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in ("lang", "source", "term")), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])

    def work(batch):
        data, at = text_buffers(batch.column("text"))
        data, at = W.LOWER[data[at[0]:at[-1]]], at - at[0]
        langs, sources = (batch.column(c).fill_null("").dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        starts, ends, row = W.find(data, at, _TERM)
        flat = np.concatenate([[0], np.cumsum(ends - starts)])
        terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(flat.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[_TERM[data]]))]).dictionary_encode()
        names = max(1, len(terms.dictionary))
        seen, n = np.unique(row * names + terms.indices.to_numpy(), return_counts=True)  # (document, term)
        cells, place = np.unique(group[seen // names] * names + seen % names, return_inverse=True)
        total = np.zeros(len(cells), np.int64)
        np.add.at(total, place, n)
        own = np.unique(group)
        every = np.concatenate([cells // names, own])
        return {"lang": langs.dictionary.take(pa.array(every // len(sources.dictionary))), "source": sources.dictionary.take(pa.array(every % len(sources.dictionary))),
                "term": pa.concat_arrays([terms.dictionary.take(pa.array(cells % names)).cast(pa.large_string()), pa.nulls(len(own), pa.large_string())]),
                "n": np.concatenate([total, np.zeros(len(own), np.int64)]),
                "docs": np.concatenate([np.bincount(place, minlength=len(cells)), np.zeros(len(own), np.int64)])}

    return map_rows(docs.select("lang", "source", "text"), work, schema, text="text")


def cells(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, total (of the language), lead (true once for each term of a language): the cells of kept terms that aren't zero, and a row with a null term for each group."""
    summed = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    column = Window.partitionBy("lang", "term")
    return (summed.withColumn("total", F.sum("n").over(column)).withColumn("within", F.sum("docs").over(column))
            .withColumn("lead", F.row_number().over(column.orderBy("source")) == 1)
            .where((F.col("within") >= DOCUMENTS) | F.col("term").isNull()).select("lang", "source", "term", "n", "total", "lead"))


def price(n: Column, total: Column, terms: Column) -> Column:
    """p of a count: exact, null where a language keeps no term."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {SCALE}) div nullif(cast({total} + {terms} as decimal(20, 0)), 0)")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


class Tree:
    """A K-squared tree with K = 2 over the cells of ``values``, whose sides are padded to a power of two."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, levels: int):
        place = np.zeros(len(rows), np.int64)
        for k in range(levels):
            place |= (rows >> k & 1) << (2 * k + 1) | (columns >> k & 1) << 2 * k
        order = np.argsort(place)
        place, self.values = place[order], values[order]
        nodes, self.bits, self.child = np.zeros(1, np.int64), [], []
        for shift in range(2 * levels - 2, -1, -2):
            below = np.unique(place >> shift)
            bits = np.zeros(4 * len(nodes), bool)
            bits[4 * np.searchsorted(nodes, below >> 2) + (below & 3)] = True
            self.bits.append(bits)
            self.child.append(np.cumsum(bits) - 1)
            nodes = below
        if not len(place):
            self.bits = [np.zeros(4, bool) for _ in range(levels)]
            self.child = [np.zeros(4, np.int64) for _ in range(levels)]

    def down(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """Children in one quadrant; -1 where it is empty."""
        at = np.maximum(node, 0) * 4 + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.child[level][at], -1)


def joint(a: Tree, b: Tree, rows_a: np.ndarray, rows_b: np.ndarray, width: int, levels: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f for all pairs of rows of two trees over the same columns: of a against b, and of b against a.

    ``rows_a`` and ``rows_b`` hold each row's price of a zero; with ``same`` only pairs whose first row comes before the second count.
    """
    height_a, height_b = len(rows_a), len(rows_b)
    there, back = np.zeros((height_a, height_b), np.int64), np.zeros((height_a, height_b), np.int64)
    empty = [np.zeros((-(-height_a >> s) or 1, -(-height_b >> s) or 1), np.int64) for s in range(levels + 1)]  # widths that are zero in both
    root = np.zeros(1, np.int64)
    stack = [(0, root, root, root, root, root)]
    while stack:
        level, *walk = stack.pop()
        if len(walk[0]) > STEP:
            half = len(walk[0]) // 2
            stack += [(level, *(x[:half] for x in walk)), (level, *(x[half:] for x in walk))]
            continue
        na, nb, ra, rb, c = walk
        if level == levels:
            if same:
                na, nb, ra, rb = (x[ra < rb] for x in (na, nb, ra, rb))
            p = np.where(na >= 0, a.values[na] if len(a.values) else 0, rows_a[ra])
            q = np.where(nb >= 0, b.values[nb] if len(b.values) else 0, rows_b[rb])
            square = (p - q) * (p - q)
            np.add.at(there, (ra, rb), square // q)
            np.add.at(back, (ra, rb), square // p)
            continue
        s, following = levels - level - 1, []
        for quadrant in range(8):
            da, db, dc = quadrant >> 2, quadrant >> 1 & 1, quadrant & 1
            xa, xb, xc = 2 * ra + da, 2 * rb + db, 2 * c + dc
            inside = (xa << s < height_a) & (xb << s < height_b) & (xc << s < width)
            if same:
                inside &= xa <= xb
            ca, cb = a.down(level, na, 2 * da + dc), b.down(level, nb, 2 * db + dc)
            none = inside & (ca < 0) & (cb < 0)
            np.add.at(empty[s], (xa[none], xb[none]), np.minimum(width - (xc[none] << s), 1 << s))
            inside &= ~none
            following.append([x[inside] for x in (ca, cb, xa, xb, xc)])
        if walk := [np.concatenate(x) for x in zip(*following)]:
            if len(walk[0]):
                stack.append((level + 1, *walk))
    zeros = sum(np.repeat(np.repeat(e, 1 << s, 0), 1 << s, 1)[:height_a, :height_b] for s, e in enumerate(empty))
    square = (rows_a[:, None] - rows_b) ** 2
    there += zeros * (square // rows_b)
    back += zeros * (square // rows_a[:, None])
    return there, back


_SUMS = "lang string, g long, h long, value long, terms long"


def _tile(key, cells):
    """Sums over the terms of a tile for all pairs between its two blocks of groups (lang, low, high, block)."""
    low, high = key[1].as_py(), key[2].as_py()
    gid, p = cells["gid"].to_numpy(), cells["p"].to_numpy()
    term = cells["term"].combine_chunks().dictionary_encode()
    columns = term.indices.to_numpy(zero_copy_only=False)
    width = len(term.dictionary)
    zero = np.isnan(columns) if columns.dtype.kind == "f" else np.zeros(len(columns), bool)
    height = max(GROUPS, width, 1)
    levels = max(1, int(height - 1).bit_length())
    trees = []
    for side in (low, high):
        own = gid // GROUPS == side
        ids = gid[own & zero]
        order = np.argsort(ids)
        ids, base = ids[order], p[own & zero][order]
        live = own & ~zero
        trees.append((ids, base, Tree(np.searchsorted(ids, gid[live]).astype(np.int64), columns[live].astype(np.int64), p[live], levels)))
    (ids_a, base_a, a), (ids_b, base_b, b) = trees
    there, back = joint(a, b, base_a, base_b, width, levels, low == high)
    x, y = np.indices(there.shape).reshape(2, -1)
    if low == high:
        x, y = x[x < y], y[x < y]
    n = 2 * len(x)
    return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "g": np.concatenate([ids_a[x], ids_b[y]]), "h": np.concatenate([ids_b[y], ids_a[x]]),
                     "value": np.concatenate([there[x, y], back[x, y]]), "terms": np.full(n, width)})


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of documents with the columns lang, source and text.

    Part ``pair``: for each group (lang, source) every other source of the language and how far the group's shares of the kept terms are from that source's. Part
    ``term``: the ``LISTED`` terms that the group has most above its language. Ranks count from 1 by falling value, then by the item's bytes.
    Null lang, source and text count as empty; a group without terms has the price of zero for each; a language that keeps no term gives
    0 for all pairs; a language of one source has no pairs; repeated rows count each time; an empty table gives no rows. Other columns aren't looked at.
    """
    cell = save(cells(docs))
    langs = cell.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("lead") & F.col("term").isNotNull()).alias("terms"), F.count_if(F.col("term").isNull()).alias("groups"))
    groups = save(cell.groupBy("lang", "source").agg(F.sum("n").alias("group_total")).join(langs, "lang")
                  .withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
                  .withColumn("zero", price("0", "group_total", "terms")))
    live = cell.where("term is not null").join(groups, ["lang", "source"]).withColumn("p", price("n", "group_total", "terms"))

    over = live.withColumn("q", price("total", "lang_total", "terms")).where("p > q").withColumn("value", F.expr(_f("p", "q")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    listed = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LISTED).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    # each cell, and each group with its price of zero, for all tiles
    last, blocks = F.expr(f"cast((groups - 1) div {GROUPS} as int)"), F.expr(f"cast((terms - 1) div {TERMS} as int) + 1")
    own = F.expr(f"cast(gid div {GROUPS} as int)")
    sides = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    dealt = (live.select("lang", "gid", "term", "p", own.alias("own"), F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
             .select("lang", *sides, "block", "gid", "term", "p"))
    zeros = (groups.where("terms > 0").select("lang", "gid", F.col("zero").alias("p"), own.alias("own"), blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("lang", *sides, "block", "gid", F.lit(None).cast("string").alias("term"), "p"))
    sums = dealt.unionByName(zeros).groupBy("lang", "low", "high", "block").applyInArrow(_tile, _SUMS).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen"))
    one = groups.select("lang", "source", F.col("gid").alias("g"), "terms", F.col("zero").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("h"), F.col("zero").alias("q"))
    rest = F.expr(f"coalesce((terms - coalesce(seen, 0)) * ({_f('p', 'q')}), 0)")  # terms that neither has, priced by their number
    pairs = (one.join(two, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left").withColumn("value", F.coalesce("value", F.lit(0)) + rest)
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(listed)
