"""Train the block labeller on pages of random make: ``python -m sourcesweep.llm.html_training``.

Every page mixes one article with furniture around it and between its paragraphs: menus, headers, adverts, notices, side
columns, forms, comments, footers, marked up by element, by class or by id, in many names. The article stands in a container
of a known name, of an invented one, of none, or straight in the body; names come in camel case, with prefixes and endings.
Held-out accuracy is printed; weights go beside ``html``.
"""

from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np

from . import html as H

HIDDEN, PAGES, EPOCHS, BATCH, RATE = 24, 12000, 7, 32, 0.01

_MAIN = ["article", "main", "div:content", "div:article body", "div:post", "section:entry content", "div:story", "div#main", "main:page", "article:post hentry", "div:text",
         "div#bodyContent", "div:markdown body", "div:prose", "td:content", "div:blog text", "section:chapter", "div#primary", "div:rich text"]
_OTHER = {
    "menu": ["nav", "ul:menu", "div:navbar", "div:navigation", "nav:breadcrumb", "div#menu", "ul:tabs", "div:nav links", "ol:breadcrumbs", "div:toc", "div:pagination"],
    "head": ["header", "div:header", "div#masthead", "header:site header", "div:topbar", "div:page header", "div:brand logo"],
    "ad": ["div:ad", "div:advert", "aside:ads", "div:sponsored", "div:promo banner", "section:advertisement", "div#ad", "div:ad slot", "p:sponsor", "div:advertising"],
    "notice": ["div:cookie notice", "div:notice", "div:alert", "div:consent banner", "div:newsletter", "dialog", "div:popup modal", "div:cookies", "section:gdpr", "div:paywall notice"],
    "side": ["aside", "div:sidebar", "div:related", "section:widget", "div:recommended", "aside:side", "div:share social", "div:tags", "div:infobox aside", "td:sidebar", "div:related posts"],
    "form": ["form", "div:search form", "form:login", "form:subscribe", "div:signup form", "fieldset"],
    "comment": ["section:comments", "div:comment list", "div#comments", "ol:commentlist", "div:reader comments", "section:responses", "div:replies", "div:discussion comments"],
    "foot": ["footer", "div:footer", "div#footer", "div:copyright", "footer:site footer", "div:legal", "div:page footer", "div:colophon"],
}
#: Elements that may stand anywhere, closed or not, with text or without; they say nothing about what is main text.
_ODD = ["svg", "math", "object", "canvas", "audio", "video", "noscript", "template"]
#: What names are dressed with, which says nothing either.
_BEFORE, _AFTER = ["site", "page", "js", "wp", "c", "main", "mw", "block", "is"], ["wrapper", "inner", "container", "box", "area", "block", "section", "full"]
#: Begins the text of main blocks while a page is made, so that leaves can be told apart however they merge.
_SIGN = "\ue000"


def _words(r: random.Random, low: int, high: int) -> str:
    """Invented prose: the network shall not learn any wording."""
    out = ["".join(r.choice("aeiouàéöñ") + r.choice("bcdfghlmnprstvwxz") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for k in range(len(out)):
        if r.random() < 0.1:
            out[k] += r.choice(",.;!?&:")
    return " ".join(out).capitalize() + r.choice([".", ".", ".", "", "!"])


def _invented(r: random.Random) -> str:
    if r.random() < 0.4:
        return r.choice(["", "css-", "sc-", "r-"]) + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDXYZ0123456789") for _ in range(r.randint(4, 9)))
    return "".join(r.choice("bcdfgklmnprstvz") + r.choice("aeiouy") for _ in range(r.randint(1, 3))) + r.choice(["", "", f"-{r.randint(1, 99)}", "__" + r.choice("abcxyz")])


def _open(r: random.Random, spec: str) -> tuple[str, str]:
    """Tags of a container; names may be dressed or have an invented one beside them."""
    name, value, attribute = spec, "", r.choice(["class", "id"])
    for sign, known in ((":", "class"), ("#", "id")):
        if sign in spec:
            (name, value), attribute = spec.split(sign), known
    parts = value.split()
    if parts:
        way = r.random()
        if way < 0.3:
            parts = [r.choice(_BEFORE), *parts] if r.random() < 0.5 else [*parts, r.choice(_AFTER)]
        value = r.choice([" ", "-", "_"]).join(parts) if way < 0.7 else parts[0] + "".join(x.capitalize() for x in parts[1:])
    if r.random() < 0.3:
        value = f"{value} {_invented(r)}".strip()
    return f'<{name} {attribute}="{value}">' if value else f"<{name}>", f"</{name}>"


def _prose(r: random.Random, low: int, high: int, sign: str = "") -> str:
    """Words, some of them in links or other elements inside the line."""
    text = sign + _words(r, low, high)
    while r.random() < 0.25:
        name = r.choice(["a href='/w'", "b", "em", "code", "span", "i", "strong"])
        text += f" <{name}>{_words(r, 1, 4)}</{name.split()[0]}> {_words(r, 1, 12)}"
    return text


def _paragraph(r: random.Random, low: int, high: int, sign: str = "") -> str:
    return r.choice(["<p>{}</p>"] * 4 + ["<p>{}<br><p>", "<p><b>{}</p>", "<p><b>{}<br><p>", "<div>{}</div>", "{}<br><br><p></p>", "<p>{}"]).format(_prose(r, low, high, sign))


def _article(r: random.Random) -> list[str]:
    """Markup of the blocks of the main text."""
    p = lambda low, high: _prose(r, low, high, _SIGN)
    many = lambda n, make: "".join(make() for _ in range(r.randint(1, n)))
    out = [f"<h1>{p(2, 12)}</h1>"] if r.random() < 0.7 else []
    if out and r.random() < 0.1:
        out = [f"<header>{out[0]}</header>"]
    short = r.random() < 0.15  # an article of short lines
    for _ in range(r.choice([1, 2, 2, 3, 5, 8, 13, 20])):
        way = r.random()
        if way < 0.72:
            out.append(_paragraph(r, *((1, 12) if short else r.choice([(1, 9), (8, 60), (20, 120), (20, 120)])), _SIGN))
            continue
        out.append(r.choice([
            lambda: f"<h{r.choice('2234')}>{p(1, 8)}</h2>", lambda: f"<blockquote>{p(5, 40)}</blockquote>", lambda: f"<blockquote>{_paragraph(r, 5, 40, _SIGN)}</blockquote>",
            lambda: f"<ul>{many(6, lambda: f'<li>{p(1, 30)}</li>')}</ul>", lambda: f"<ol>{many(5, lambda: f'<li><p>{p(2, 30)}</p></li>')}</ol>",
            lambda: f"<ul>{many(4, lambda: f'<li>{p(1, 9)}<ul>{many(3, lambda: f'<li>{p(1, 20)}')}</ul></li>')}</ul>",
            lambda: f"<figure><img src=x><figcaption>{p(2, 14)}</figcaption></figure>", lambda: f"<pre>{p(3, 30)}</pre>",
            lambda: f"<table>{many(5, lambda: '<tr>' + many(4, lambda: f'<td>{p(1, 5)}</td>') + '</tr>')}</table>",
            lambda: f"<table><tr><th>{p(1, 3)}<th>{p(1, 3)}</tr>{many(4, lambda: f'<tr><td>{p(1, 6)}<td>{p(1, 20)}')}</table>",
            lambda: f"<dl>{many(4, lambda: f'<dt>{p(1, 4)}</dt><dd>{p(3, 30)}</dd>')}</dl>", lambda: f"<details><summary>{p(1, 6)}</summary>{_paragraph(r, 5, 40, _SIGN)}</details>"])())
    return out


def _furniture(r: random.Random, kind: str) -> str:
    """One container of what is no main text."""
    begin, end = _open(r, r.choice(_OTHER[kind]))
    links = lambda n, low, high: "".join(r.choice(['<li><a href="/x">{}</a></li>', '<li><a href="/x">{}</a>', '<div><a href="#">{}</a></div>', '<a href="#">{}</a> ']).format(_words(r, low, high)) for _ in range(r.randint(2, n)))
    title = f"<h{r.choice('234')}>{_words(r, 1, 4)}</h3>" if r.random() < 0.4 else ""
    if kind == "menu" or kind in ("side", "head", "foot") and r.random() < 0.5:
        inner = links(9, 1, 8 if kind == "side" else 4)
        inner = title + (f"<ul>{inner}</ul>" if r.random() < 0.4 else inner)
    elif kind == "form":
        inner = "".join(r.choice(["<label>{}</label><input>", "<button>{}</button>", "<p>{}</p>", "<select><option>{}</option></select>"]).format(_words(r, 1, 8)) for _ in range(r.randint(1, 4)))
    elif kind == "comment":
        inner = title + "".join(r.choice(["{}", "<div>{}</div>", "<li>{}</li>", "<article>{}</article>"]).format(
            (f"<b>{_words(r, 1, 2)}</b>" if r.random() < 0.4 else "") + _paragraph(r, 2, 60)) for _ in range(r.randint(1, 8)))
    else:
        inner = title + "".join(r.choice([_words(r, 2, 25), _paragraph(r, 3, 40), "<ul>" + "".join(f"<li>{_words(r, 1, 12)}</li>" for _ in range(r.randint(1, 4))) + "</ul>"])
                                for _ in range(r.randint(1, 3)))
    odd = r.choice(_ODD)
    return r.choice([f"<{odd}>", f"<{odd}></{odd}>"]) * (r.random() < 0.03) + begin + inner + end


def _around(r: random.Random, markup: str) -> str:
    """Boxes that say nothing, with a name or without."""
    while r.random() < 0.35:
        begin, end = _open(r, r.choice(["div", "div", "section", "div:wrap", "div:container", "div:row", "div:" + _invented(r), "div:" + _invented(r), "div#" + _invented(r)]))
        markup = begin + markup + end
    return markup


def page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its leaves, whether it is main text; the sign in front of main text is still there."""
    blocks = _article(r)
    if r.random() < 0.3:
        odd, k = r.choice(_ODD), r.randrange(len(blocks))
        blocks[k] = r.choice([f"<{odd}>{blocks[k]}</{odd}>", f"<{odd}>{blocks[k]}", f"<{odd}></{odd}>{blocks[k]}", f"<p><{odd}>{_SIGN}{_words(r, 1, 9)}</{odd}></p>{blocks[k]}"])
    if r.random() < 0.2:  # parts of the article in boxes of their own
        k = r.randrange(len(blocks))
        blocks[k:] = [_around(r, r.choice(["<section>{}</section>", "<div>{}</div>"]).format("".join(blocks[k:])))]
    while r.random() < 0.35:  # furniture between paragraphs
        blocks.insert(r.randint(0, len(blocks)), _furniture(r, r.choice(["ad", "ad", "side", "form", "notice", "menu"])))
    if r.random() < 0.1:
        blocks.append(_furniture(r, "comment"))
    way = r.random()
    begin, end = ("", "") if way < 0.15 else _open(r, r.choice(_MAIN)) if way < 0.6 else _open(r, r.choice(["div", "div", "section", "td"]) + r.choice(["", ":", "#"]).replace(":", ":" + _invented(r)).replace("#", "#" + _invented(r)))
    if begin.startswith("<td"):
        begin, end = "<table><tr>" + begin, end + "</table>"
    main = begin + "".join(blocks) + end
    main = f"<main>{main}</main>" if r.random() < 0.15 else main
    bare = r.random() < 0.1  # nothing but the article
    before = [k for k in ("notice", "head", "menu", "ad", "side") if not bare and r.random() < 0.5]
    after = [k for k in ("comment", "side", "ad", "form", "notice", "menu") if not bare and r.random() < 0.3]
    r.shuffle(before)
    r.shuffle(after)
    middle = [_furniture(r, k) for k in before] + [_around(r, main)] * (bare or r.random() < 0.97) + [_furniture(r, k) for k in after]
    if r.random() < 0.4:  # some of the furniture shares a box with the article
        low, high = r.randint(0, len(middle)), r.randint(0, len(middle))
        middle[min(low, high):max(low, high)] = [_around(r, "".join(middle[min(low, high):max(low, high)]))]
    build = "".join(middle) + (_furniture(r, "foot") if not bare and r.random() < 0.7 else "")
    if r.random() < 0.15:  # a page whose elements all have invented names
        name = {x: " ".join(_invented(r) for _ in range(r.randint(1, 2))) for x in ("p", "div", "section", "li", "ul", "h1", "h2", "td", "article", "main", "nav", "footer")}
        build = re.sub(r"<(\w+)>", lambda m: f'<{m[1]} class="{name[m[1]]}">' if m[1] in name else m[0], build)
    html = "<!DOCTYPE html><html><head><title>x</title></head><body>" + build + "</body></html>"
    return html, [_SIGN in b.text for b in H.leaves(html)]


def train(seed: int = 11) -> dict:
    r = random.Random(seed)
    data = []
    while len(data) < PAGES:
        html, marks = page(r)
        if marks:
            data.append((H.vectors(H.leaves(html.replace(_SIGN, ""))), np.array(marks, np.float32)))
    test, data = data[:600], data[600:]
    g = np.random.default_rng(seed)
    w = {"v": g.normal(0, 0.3, (2 * HIDDEN, 1)), "c": np.zeros(1)}
    for side in "fb":
        w |= {f"w{side}": g.normal(0, 0.1, (H.INPUTS, 4 * HIDDEN)), f"u{side}": g.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"b{side}": np.repeat([0, 1.0, 0, 0], HIDDEN)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = sorted(range(len(data)), key=lambda k: len(data[k][1]) + g.random() * 4)
        groups = [order[k:k + BATCH] for k in range(0, len(order), BATCH)]
        for group in (groups[k] for k in g.permutation(len(groups))):
            step += 1
            grads = gradient([data[k] for k in group], w)
            for k, d in grads.items():
                d = np.clip(d, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                w[k] -= RATE * (0.5 ** (epoch / 2)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        p = H.probabilities([x for x, _ in test], w)
        print(epoch, "held-out block accuracy", round(float(np.mean(np.concatenate([(a >= 0.5) == (y > 0.5) for a, (_, y) in zip(p, test)]))), 5))
    return w


def gradient(batch: list, w: dict) -> dict:
    """Gradient of the mean cross entropy, backwards through time in both directions."""
    steps, pages = max(len(y) for _, y in batch), len(batch)
    x, y, mask = np.zeros((steps, pages, H.INPUTS), np.float32), np.zeros((steps, pages), np.float32), np.zeros((steps, pages), bool)
    for j, (a, b) in enumerate(batch):
        x[:len(b), j], y[:len(b), j], mask[:len(b), j] = a, b, True
    kept: dict = {"f": [], "b": []}
    hidden = {s: H.run_lstm(x, mask, w, s, kept[s]) for s in "fb"}
    both = np.concatenate([hidden["f"], hidden["b"]], 2)
    error = ((H._sigmoid(both @ w["v"] + w["c"])[:, :, 0] - y) * mask / mask.sum())[:, :, None]
    grads = {"v": np.einsum("tph,tpo->ho", both, error), "c": error.sum((0, 1))}
    size = w["uf"].shape[0]
    for n, side in enumerate("fb"):
        to_h = error @ w["v"][n * size:(n + 1) * size].T
        u, dh, dc = w[f"u{side}"], np.zeros((pages, size), np.float32), np.zeros((pages, size), np.float32)
        dg = np.zeros((steps, pages, 4 * size), np.float32)
        du = np.zeros_like(u)
        for t, h, c, i, f, o, z, new in reversed(kept[side]):
            m = mask[t][:, None]
            dh = dh + to_h[t]
            th = np.tanh(new)
            dn = np.where(m, dc + dh * o * (1 - th * th), 0)
            dg[t] = np.concatenate([dn * z * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * th * o * (1 - o), 0), dn * i * (1 - z * z)], 1)
            du += h.T @ dg[t]
            dc = np.where(m, dn * f, dc)
            dh = np.where(m, 0, dh) + dg[t] @ u.T
        grads |= {f"w{side}": np.einsum("tpi,tpg->ig", x, dg, optimize=True), f"u{side}": du, f"b{side}": dg.sum((0, 1))}
    return grads


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).parent / H.WEIGHTS, **train())
