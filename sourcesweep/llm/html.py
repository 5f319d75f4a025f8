"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks. Each block is a vector: hashed tag and class names on its path and of its own
element, hashed words, and a few measures, among them the share of the page's text that stands in the same box; a
bidirectional LSTM in numpy reads the whole sequence and decides about every block. Its weights are trained by
``html_training`` on pages of random make and lie beside this module.

A path is kept as a set of bits that grows on the way down, so that an element costs the same at any depth, and places of
open elements are looked up by name: reading is linear in the page, also with many unclosed elements or stray end tags.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from html import unescape
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .arrow import map_rows

PATH_CELLS, OWN_CELLS, WORD_CELLS, MEASURES = 320, 96, 24, 10
INPUTS = PATH_CELLS + OWN_CELLS + WORD_CELLS + MEASURES
#: Pages that are read in step, and blocks of them together at most (a longer page is read alone).
STEP_PAGES, STEP_BLOCKS = 64, 4096

#: Elements that end a block where they begin and end, elements without content, and elements whose text is
#: no markup and that nobody reads; these go on to their end tag, or to the end of the page.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
                  "h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
                  "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that stand apart from the text around them without ending a paragraph; an open one doesn't hide what follows.
APART = frozenset("noscript template svg object canvas audio video".split())
#: Elements of other languages, in which "/>" closes, and elements that end them when they begin, as those of BLOCK do.
FOREIGN = frozenset(("svg", "math"))
LEAVES_FOREIGN = frozenset("b big br code em embed i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
#: A new one of these ends an open one of those.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HOLDS = frozenset("ul ol menu dl table select body article section div object template".split())
#: Elements that hold blocks together; their share of the page's text tells where the article is.
BOX = frozenset("article aside blockquote body details dialog div dl fieldset footer form header main menu nav ol search section table td ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@functools.lru_cache(maxsize=None)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


class Block(NamedTuple):
    """A leaf: its text, characters inside links, cells of the names on its path and of its own element, depth, box and the box around that."""

    text: str
    linked: int
    path: int
    own: int
    depth: int
    box: int
    outer: int


@functools.lru_cache(maxsize=1 << 14)
def _cells(names: tuple[str, ...], size: int) -> int:
    """Two places for each name, as bits; elements have the lower third for themselves, so that no invented name looks like one."""
    bits, third = 0, size // 3
    for name in names:
        h = zlib.crc32(name.encode())
        low, width = (0, third) if name[0] == "<" else (third, size - third)
        bits |= 1 << low + h % width | 1 << low + (h >> 12) % width
    return bits


def leaves(html: str) -> list[Block]:
    """Blocks in page order."""
    out: list[Block] = []
    stack: list[tuple] = [("", 0, 0, 0, 0, 0)]  # name, and what a block tells from its path on
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by name, lowest first
    parts: list[str] = []
    linked = boxes = 0

    def text(s: str) -> None:
        nonlocal linked
        if s:
            s = unescape(s)
            parts.append(s)
            if opened["a"]:
                linked += len(s.strip())

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(parts).split())
        if whole:
            out.append(Block(whole, linked, *stack[-1][1:]))
        parts.clear()
        linked = 0

    def top(names) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        return max((opened[name][-1] for name in names if opened[name]), default=0)

    def close(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop()[0]].pop()

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        text(html[at:m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            if name in BLOCK or name in APART:
                flush()
            if opened[name]:
                close(opened[name][-1])
            continue
        while (name in LEAVES_FOREIGN or name in BLOCK) and top(FOREIGN) > top(("foreignobject",)):
            flush()
            close(top(FOREIGN))
        foreign = top(FOREIGN)
        if name in UNREAD:
            if not (foreign and rest.endswith("/")):
                m = _end_of(name).search(html, at)
                at = m.end() if m else at if foreign else len(html)
            continue
        if name == "br":
            parts.append(" ")
        if name in APART:
            flush()
        if name in BLOCK:
            flush()
            floor = top(_HOLDS)
            ended = [opened[x][k] for x in ("p", *ENDS.get(name, ())) for k in [bisect_right(opened[x], floor)] if k < len(opened[x])]
            if ended:
                close(min(ended))
        if name in VOID or rest.endswith("/") and (foreign or name in FOREIGN):
            continue
        names = [f"<{name}"]
        if name not in ("html", "body"):  # what these are called says nothing about any block
            for v in _NAMES.finditer(rest):
                names += [x.lower() for x in _PART.findall(v[1] or v[2] or v[3] or "")]
        names = tuple(names)
        _, path, own, depth, box, outer = stack[-1]
        if name in BOX:
            boxes += 1
            box, outer = boxes, box
        opened[name].append(len(stack))
        stack.append((name, path | _cells(names, PATH_CELLS), _cells(names, OWN_CELLS) if name in BLOCK else own, depth + 1, box, outer))
    flush()
    return out


def _bits(sets: list[int], size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(x.to_bytes(size // 8, "little") for x in sets), np.uint8).reshape(-1, size // 8), axis=1, bitorder="little")


def _shares(page: np.ndarray, box: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each block, the share of its page's weight that stands in the same box of that page."""
    _, of = np.unique(np.stack([page, box]), axis=1, return_inverse=True)
    of = of.reshape(-1)
    return np.bincount(of, weight)[of] / np.maximum(np.bincount(page, weight)[page], 1)


def vectors(blocks: list[Block], borders: list[int] | None = None) -> np.ndarray:
    """What the network reads of each block; pages begin and end at ``borders`` (default: all blocks are one page)."""
    x = np.zeros((len(blocks), INPUTS), np.float32)
    if not blocks:
        return x
    texts = [b.text.encode() for b in blocks]
    data = W.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, row = W.find(data, offsets, W.LETTERS)
    cell = (W.hashes(data, starts, ends) % np.uint64(WORD_CELLS)).astype(np.int64)
    count = np.bincount(row * WORD_CELLS + cell, minlength=len(blocks) * WORD_CELLS).reshape(-1, WORD_CELLS)
    n = np.maximum(count.sum(1), 1)
    x[:, :PATH_CELLS] = _bits([b.path for b in blocks], PATH_CELLS)
    x[:, PATH_CELLS:PATH_CELLS + OWN_CELLS] = _bits([b.own for b in blocks], OWN_CELLS)
    x[:, PATH_CELLS + OWN_CELLS:-MEASURES] = count / n[:, None]
    stops = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)))])
    length, linked = np.array([len(b.text) for b in blocks]), np.array([b.linked for b in blocks])
    edges = np.unique([0, len(blocks)] if borders is None else borders)
    page = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    plain = np.maximum(length - linked, 0).astype(float)
    x[:, -10] = _shares(page, np.array([b.box for b in blocks]), plain)
    x[:, -9] = _shares(page, np.array([b.outer for b in blocks]), plain)
    x[:, -8] = np.log1p(length) / 6
    x[:, -7] = np.log1p(n) / 5
    x[:, -6] = np.minimum(1.0, linked / length)
    x[:, -5] = np.diff(stops[offsets]) / np.diff(offsets) * 10
    x[:, -4] = np.minimum([b.depth for b in blocks], 20) / 10
    x[edges[:-1], -3] = 1
    x[edges[1:] - 1, -2] = 1
    x[:, -1] = [b.text[-1] in ".!?\"'" for b in blocks]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: dict, side: str, keep: list | None = None) -> np.ndarray:
    """Hidden states for x (step, page, input); masked steps leave the state as it is."""
    steps, pages, _ = x.shape
    size = w[f"u{side}"].shape[0]
    gates = x @ w[f"w{side}"] + w[f"b{side}"]
    h, c = np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
    out = np.zeros((steps, pages, size), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        g = gates[t] + h @ w[f"u{side}"]
        i, f, o = _sigmoid(g[:, :size]), _sigmoid(g[:, size:2 * size]), _sigmoid(g[:, 2 * size:3 * size])
        z = np.tanh(g[:, 3 * size:])
        new = f * c + i * z
        m = mask[t][:, None]
        if keep is not None:
            keep.append((t, h, c, i, f, o, z, new))
        c = np.where(m, new, c)
        h = np.where(m, o * np.tanh(new), h)
        out[t] = h
    return out


def probabilities(pages: list[np.ndarray], w: dict) -> list[np.ndarray]:
    """For each page, the probability of each of its blocks to be main text."""
    out: list = [np.zeros(0)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    while order:
        group = [order.pop()]
        while order and len(group) < STEP_PAGES and (len(group) + 1) * len(pages[group[0]]) <= STEP_BLOCKS:
            group.append(order.pop())
        steps = len(pages[group[0]])
        x, mask = np.zeros((steps, len(group), INPUTS), np.float32), np.zeros((steps, len(group)), bool)
        for j, k in enumerate(group):
            x[:len(pages[k]), j] = pages[k]
            mask[:len(pages[k]), j] = True
        both = np.concatenate([run_lstm(x, mask, w, "f"), run_lstm(x, mask, w, "b")], 2)
        p = _sigmoid(both @ w["v"] + w["c"])[:, :, 0]
        for j, k in enumerate(group):
            out[k] = p[:len(pages[k]), j]
    return out


WEIGHTS = "html_weights.npz"


def load_weights() -> dict:
    with np.load(Path(__file__).parent / WEIGHTS) as f:
        return {k: f[k] for k in f.files}


def extract(pages: DataFrame, *, html: str = "html", weights: dict | None = None, least: float = 0.5) -> DataFrame:
    """All columns of ``pages``, and text (main blocks joined by one space) and blocks (text, probability).

    Null and empty pages, and pages without main text, have an empty text. The weights, under 400 KB, go with the job.
    """
    weights = weights or load_weights()
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("p", T.DoubleType())])
    new = [T.StructField("text", T.StringType()), T.StructField("blocks", T.ArrayType(block))]
    kept = [f for f in pages.schema.fields if f.name not in ("text", "blocks")]

    def work(batch):
        found = [leaves(x or "") for x in batch.column(html).to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).tolist()
        x = vectors([b for own in found for b in own], ends)
        p = probabilities([x[a:b] for a, b in zip(ends, ends[1:])], weights)
        return {f.name: batch.column(f.name) for f in kept} | {
            "text": [" ".join(b.text for b, y in zip(own, q) if y >= least) for own, q in zip(found, p)],
            "blocks": [[{"text": b.text, "p": float(y)} for b, y in zip(own, q)] for own, q in zip(found, p)]}

    return map_rows(pages, work, T.StructType(kept + new), limit=1 << 20, text=html)


def main_text(pages: DataFrame, **options) -> DataFrame:
    """Like ``extract``, without the list of blocks."""
    return extract(pages, **options).drop("blocks").withColumn("n_chars", F.length("text").cast("long"))
