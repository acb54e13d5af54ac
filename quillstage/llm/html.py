"""HTML extraction by a recurrent block labeller.

A page is cut into its leaf blocks: stretches of text between the tags of block elements. Every block has a vector of its
tag path (tags, classes and ids of the open elements, hashed), of its words (hashed) and of a few figures (length, links,
punctuation, place). A bidirectional LSTM in numpy reads the blocks of a page in order and labels each with the whole page as
context; the blocks labelled as text, joined by line feeds, are the result.

The model is trained here, on the driver and within seconds, from a fixed seed on pages that ``pages_made`` composes by rule:
articles in various containers among menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Some
pages name nothing by what it is, so that words, length, links and neighbours must tell. No row of the tables takes part. Its
weights, some 200 kB whatever the input, are broadcast.

A page is held whole, blocks of many pages are labelled in batches of bounded size. Character references are decoded once,
after markup has gone. Scripts, styles, comments and titles have no text, also where they are not closed; a drawing (svg) has
none up to its end tag, and is its start tag alone where it closes itself or has no end tag. Formulas and the text that stands
for an object are left to the labeller.

Defined results: null, empty and textless pages give the empty text; equal pages give equal texts; elements of any other name
are no more than their text; a quote encloses a value only behind the sign of equality and where it ends; markup that does not
nest is read as it comes: an end tag without a start is ignored; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.llm.common import read

SILENT = "script|style|noscript|template|title|textarea|iframe"
#: What stands in a tag behind its name: quotes enclose a value behind the sign of equality alone, and only where they end.
_REST = r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+"
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({SILENT})(?=[\s/>]){_REST}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-z][a-z0-9:_.-]*)((?![^\s/>]){_REST})>|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL
)
_DRAWN = re.compile(r"</svg(?=[\s/>])[^>]*>", re.IGNORECASE)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+|©")
# Elements that begin and end blocks, and those that an opening block ends.
BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr select option label button legend center menu dialog".split()
)
VOID = frozenset(["hr"])
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}
}
INTO = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    links: int = 0
    linked: int = 0

    def text(self, piece: str) -> None:
        if piece:
            self.parts.append(piece)
            if self.links:
                self.linked += len(piece)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append(Block(text, tuple(x for _, names in self.stack for x in names), self.linked))
            self.parts.clear()
        self.linked = 0

    def tag(self, closing: bool, name: str, rest: str) -> None:
        if name == "a":
            self.links = 0 if closing else 1
            return
        if name == "br":
            self.text(" ")
            return
        if name not in BLOCKS:
            return
        self.end_block()
        self.links = 0
        if closing:
            if any(n == name for n, _ in self.stack):
                while self.stack.pop()[0] != name:
                    pass
            return
        until = INTO.get(name, set())
        for k in range(len(self.stack) - 1, -1, -1):
            open_name = self.stack[k][0]
            if open_name in until:
                break
            if open_name in ENDS.get(name, {"p"}):
                del self.stack[k:]
                if open_name in ("p", name) and name not in ("td", "th", "tr"):
                    break
            elif open_name != "p" and name not in ENDS:
                break
        if name not in VOID:
            names = [f"<{name}"]
            if rest and "=" in rest:
                for m in _NAMES.finditer(rest):
                    names += _PART.findall((m[1] or m[2] or m[3] or "").lower())
            self.stack.append((name, tuple(names)))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with the names of their open elements and how much of them is linked."""
    page, reader, at, drawn = page or "", _Reader(), 0, True
    last = page.rfind(">")
    # behind the last sign that ends a tag none is sought, which could take the square of the page's length
    while at <= last and (m := _MARKUP.search(page, at)):
        reader.text(page[at : m.start()])
        at = m.end()
        if m[3] and drawn and not m[2] and m[3].lower() == "svg" and not m[4].endswith("/"):
            end = _DRAWN.search(page, at)
            at, drawn = end.end() if end else at, end is not None
        elif m[3]:
            reader.tag(bool(m[2]), m[3].lower(), m[4])
    reader.text(page[at:] if at <= last else page[at:].partition("<!--")[0])
    reader.end_block()
    return reader.blocks


PATH_BUCKETS, WORD_BUCKETS, PATH_SIZE, WORD_SIZE, FIGURES, HIDDEN = 512, 1024, 12, 6, 7, 16
INPUT = PATH_SIZE + WORD_SIZE + FIGURES


class _Hashes(dict):
    """Hash of a name in so many buckets, remembered up to a bound."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[name] = value = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets
        return value


_PATHS, _WORDS = _Hashes(PATH_BUCKETS), _Hashes(WORD_BUCKETS)


def _figures(block: Block, i: int) -> list[float]:
    t, size = block.text, len(block.text)
    stops = t.count(".") + t.count("!") + t.count("?")
    words = t.count(" ") + 1
    return [
        min(np.log1p(size) / 6, 2.0), min(np.log1p(words) / 5, 2.0), min(1.0, block.linked / size), min(1.0, 4 * stops / words),
        min(1.0, 4 * t.count(",") / words), float(i == 0), float(t[-1] in ".!?:")
    ]


def _numbers(pages: list[list[Block]]):
    """Bucket numbers of all blocks one after the other with their ends, and the figures."""
    paths, path_ends, words, word_ends, figures = [], [], [], [], []
    for page in pages:
        for i, b in enumerate(page):
            paths += [_PATHS[x] for x in b.path] or [_PATHS["<none"]]
            path_ends.append(len(paths))
            words += [_WORDS[x] for x in _WORD.findall(b.text.lower())] or [_WORDS[""]]
            word_ends.append(len(words))
            figures.append(_figures(b, i))
    return np.array(paths), np.array(path_ends), np.array(words), np.array(word_ends), np.array(figures, np.float32)


def _together(parts: list[tuple]) -> tuple:
    """The numbers of many pages, from those of each."""
    paths, path_ends, words, word_ends, figures = (list(x) for x in zip(*parts, strict=True))
    shifted = lambda ends, which: np.concatenate([e + at for e, at in zip(ends, np.cumsum([0, *map(len, which[:-1])]), strict=True)])
    return np.concatenate(paths), shifted(path_ends, paths), np.concatenate(words), shifted(word_ends, words), np.concatenate(figures)


def _mean(table: np.ndarray, which: np.ndarray, ends: np.ndarray) -> np.ndarray:
    starts = np.r_[0, ends[:-1]]
    return np.add.reduceat(table[which], starts, axis=0) / (ends - starts)[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Rows of a product that one thread computes; more threads cost more here than they give.
ROWS = 128


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b if len(a) <= ROWS else np.concatenate([a[i : i + ROWS] @ b for i in range(0, len(a), ROWS)])


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of the transposed first with the second."""
    return sum(a[i : i + ROWS].T @ b[i : i + ROWS] for i in range(0, len(a), ROWS))


class Labeller:
    """The model: embeddings, an LSTM in either direction, and one output per block."""

    def __init__(self, seed: int = 7) -> None:
        g = np.random.default_rng(seed)
        draw = lambda *shape, scale: (g.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "path": draw(PATH_BUCKETS, PATH_SIZE, scale=0.5), "word": draw(WORD_BUCKETS, WORD_SIZE, scale=0.1),
            "out": draw(2 * HIDDEN, scale=0.3), "out0": np.zeros(1, np.float32)
        }
        for d in "fb":
            self.p |= {
                f"w{d}": draw(INPUT, 4 * HIDDEN, scale=0.25), f"u{d}": draw(HIDDEN, 4 * HIDDEN, scale=0.25),
                f"b{d}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
            }

    def _vectors(self, numbers) -> np.ndarray:
        paths, path_ends, words, word_ends, figures = numbers
        return np.concatenate([_mean(self.p["path"], paths, path_ends), _mean(self.p["word"], words, word_ends), figures], axis=1)

    @staticmethod
    def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of every (step, page) in the flat order, forwards and backwards; -1 beyond a page's end."""
        steps, starts = np.arange(lengths.max())[:, None], np.cumsum(lengths) - lengths
        inside = steps < lengths
        return np.where(inside, starts + steps, -1), np.where(inside, starts + lengths - 1 - steps, -1)

    def _run(self, x: np.ndarray, grid: np.ndarray, d: str, keep: bool):
        w, u, b = self.p[f"w{d}"], self.p[f"u{d}"], self.p[f"b{d}"]
        z_in = np.vstack([_times(x, w) + b, b[None]])[grid]
        h = c = np.zeros((grid.shape[1], HIDDEN), np.float32)
        out = np.empty((*grid.shape, HIDDEN), np.float32)
        kept = []
        for t in range(len(grid)):
            z = z_in[t] + h @ u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = h, c
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
            if keep:
                kept.append((i, f, o, g, c, *before))
        return out, kept

    def _flat(self, out: np.ndarray, grid: np.ndarray, n: int) -> np.ndarray:
        flat = np.empty((n, HIDDEN), np.float32)
        flat[grid[grid >= 0]] = out[grid >= 0]
        return flat

    def scores(self, pages: list[list[Block]]) -> np.ndarray:
        """Log odds of being text for all blocks of pages that have some."""
        lengths = np.array([len(p) for p in pages])
        x = self._vectors(_numbers(pages))
        grids = self._grid(lengths)
        hidden = [self._flat(self._run(x, grid, d, False)[0], grid, len(x)) for d, grid in zip("fb", grids, strict=True)]
        return (np.concatenate(hidden, axis=1) * self.p["out"]).sum(axis=1) + self.p["out0"]

    def gradients(self, numbers: tuple, lengths: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients on pages of so many blocks that are labelled."""
        x, grids = self._vectors(numbers), self._grid(lengths)
        runs = [self._run(x, grid, d, True) for d, grid in zip("fb", grids, strict=True)]
        hidden = np.concatenate([self._flat(r[0], grid, len(x)) for r, grid in zip(runs, grids, strict=True)], axis=1)
        odds = _sigmoid((hidden * self.p["out"]).sum(axis=1) + self.p["out0"])
        loss = -np.mean(np.log(np.where(wanted, odds, 1 - odds) + 1e-7))
        wrong = ((odds - wanted) / len(x)).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"], grad["out0"] = (hidden * wrong[:, None]).sum(axis=0), wrong.sum(keepdims=True)
        d_hidden, d_x = wrong[:, None] * self.p["out"], np.zeros_like(x)
        for k, (d, grid) in enumerate(zip("fb", grids, strict=True)):
            d_out = np.vstack([d_hidden[:, k * HIDDEN : (k + 1) * HIDDEN], np.zeros((1, HIDDEN), np.float32)])[grid]
            u, d_h, d_c = self.p[f"u{d}"], 0, 0
            d_z = np.empty((*grid.shape, 4 * HIDDEN), np.float32)
            for t in range(len(grid) - 1, -1, -1):
                i, f, o, g, c, h0, c0 = runs[k][1][t]
                th = np.tanh(c)
                d_h = d_h + d_out[t]
                d_c = d_c + d_h * o * (1 - th * th)
                d_z[t] = np.concatenate([d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), d_h * th * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                grad[f"u{d}"] += h0.T @ d_z[t]
                d_h, d_c = d_z[t] @ u.T, d_c * f
            inside = grid >= 0
            rows, flat = grid[inside], d_z[inside]
            grad[f"w{d}"] += _crossed(x[rows], flat)
            grad[f"b{d}"] += flat.sum(axis=0)
            d_x[rows] += _times(flat, self.p[f"w{d}"].T)
        for name, at, size, which, ends in (("path", 0, PATH_SIZE, numbers[0], numbers[1]), ("word", PATH_SIZE, WORD_SIZE, numbers[2], numbers[3])):
            n = np.diff(np.r_[0, ends])
            owner = np.repeat(np.arange(len(n)), n)
            for k in range(size):
                grad[name][:, k] = np.bincount(which, (d_x[:, at + k] / n)[owner], len(grad[name]))
        return float(loss), grad


@lru_cache(1)
def train(seed: int = 7, pages: int = 2400, epochs: int = 10, batch: int = 32, rate: float = 0.015) -> Labeller:
    """A labeller trained on composed pages by Adam, from a fixed seed; once in a process."""
    model, rng = Labeller(seed), random.Random(seed)
    made = [pages_made(rng) for _ in range(pages)]
    made = [(_numbers([[b for b, _ in page]]), np.array([y for _, y in page], np.float32)) for page in made]
    sums = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rng.shuffle(made)
        # pages of like length go together, so that few steps are spent on padding
        near = [sorted(made[i : i + 8 * batch], key=lambda page: len(page[1])) for i in range(0, pages, 8 * batch)]
        batches = [part[i : i + batch] for part in near for i in range(0, len(part), batch)]
        rng.shuffle(batches)
        for part in batches:
            wanted = [y for _, y in part]
            _, grad = model.gradients(_together([n for n, _ in part]), np.array([len(y) for y in wanted]), np.concatenate(wanted))
            step += 1
            for k, g in grad.items():
                m, v = sums[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                model.p[k] -= rate * (0.4 ** max(0, epoch - epochs // 2)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


# Names that pages give to what is not their text, with elements that hold it, and words that stand there.
ASIDE = {
    "menu": (
        "nav div header ul", "nav navbar menu navigation topbar breadcrumb breadcrumbs pagination pager toc",
        "home about contact login menu search archive next previous"
    ),
    "header": ("header div", "header masthead site banner logo branding", "welcome search login subscribe home"),
    "footer": ("footer div", "footer colophon copyright legal bottom", "copyright rights reserved privacy terms imprint"),
    "sidebar": ("aside div section", "sidebar widget related popular recommended recent rail tags share social author", "related popular recent more tags share follow"),
    "notice": (
        "div section aside dialog", "cookie consent notice alert popup modal newsletter signup subscribe gdpr message",
        "cookies accept consent newsletter subscribe settings"
    ),
    "advert": ("div aside section ins", "ad ads advert advertisement sponsored promo banner sponsor", "advertisement sponsored buy now offer"),
    "form": ("form div", "form search login contact signup poll survey", "name email password submit send search"),
    "comments": ("div section ol ul", "comments comment replies reply discussion responses respond disqus thread", "reply comments says ago report like"),
}
TEXT_IN = (
    "article", "main", "article content", "div content", "div post entry", "div article body", "section story", "div main text",
    "main article", "div page content", ""
)
_SYLLABLES = "an ar be ca da de el en er es et fi ga he in is ka la le li lo ma mi na ne no on or pa ra re ri ro sa se si so sta ta te ti to tra un ur va ve vi wa we".split()


@lru_cache(1)
def _vocabulary() -> list[str]:
    rng = random.Random(1)
    return ["".join(rng.choices(_SYLLABLES, k=rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(20_000)]


def pages_made(rng: random.Random) -> list[tuple[Block, float]]:
    """The labelled blocks of one composed page."""
    word = lambda: rng.choice(_vocabulary())
    words = lambda n: rng.choices(_vocabulary(), k=max(1, n))
    page: list[tuple[Block, float]] = []
    # how the page names its elements: by what they are, by signs of its own, or not at all
    manner = rng.choices(("telling", "own", "none"), (0.72, 0.1, 0.18))[0]
    named = lambda names: [x for n in names for x in ([n] if manner == "telling" else [word()] if manner == "own" else [])]

    def prose(n: int) -> str:
        said, left = [], n
        while left > 0:
            k = min(left, rng.randint(1, 14))
            s = words(k)
            if k > 5 and rng.random() < 0.4:
                s[k // 2] += ","
            said.append(" ".join(s).capitalize() + rng.choice("....!?"))
            left -= k
        return " ".join(said)

    def noisy(text: str) -> str:
        kind = rng.random()
        if kind > 0.96:
            return " ".join([text.split()[0]] * (text.count(" ") + 1))
        return text.upper() if kind < 0.03 else re.sub(r"(?<=\w) ", rng.choice((" ### ", "*** ", "%%% ", "&&& ", " | ", "!! ")), text) if kind < 0.1 else text

    def put(text: str, path: list[str], y: float, linked: float = 0.0) -> None:
        page.append((Block(text, tuple(path), int(linked * len(text))), y))

    def aside(kind: str, outer: list[str]) -> None:
        tags, names, said = (x.split() for x in ASIDE[kind])
        tag = rng.choice(tags) if manner == "telling" or rng.random() < 0.5 else "div"
        path = [*outer, f"<{tag}", *named(rng.sample(names, rng.randint(1, min(2, len(names)))) if tag in ("div", "section", "ul", "ol") or rng.random() < 0.5 else [])]
        if rng.random() < 0.5 and first == "td":
            tag, path = "td", [*wrap, "<table", "<tr", "<td"]
        plain = manner != "telling" and tag in ("div", "section", "ul", "ol", "td")
        flat = not plain and kind in ("comments", "advert", "notice", "footer", "sidebar")
        if flat and rng.random() < (0.85 if kind in ("comments", "advert") else 0.6):
            for _ in range(rng.randint(1, 9) if kind == "comments" else rng.randint(1, 3)):
                inner = [*path, *rng.choice((["<p"], ["<p"], [], ["<div"], ["<li"]))]
                if kind == "comments" and rng.random() < 0.5:
                    put(" ".join([word().title(), *rng.sample(said, 1)]), [*path, rng.choice(("<div", "<h4", "<p"))], 0.0, rng.choice((0.0, 0.5)))
                text = prose(rng.choice((3, 8, 20, 50)))
                put(
                    noisy(f"{' '.join(rng.sample(said, 1))} {text}" if rng.random() < 0.3 else f"© {text}" if kind == "footer" and rng.random() < 0.7 else text),
                    inner, 0.0, rng.choice((0.0, 0.0, 0.3))
                )
            return
        for _ in range(rng.randint(2, 10)):
            inner = [*path, *(["<label"] if kind == "form" and rng.random() < 0.5 else rng.choice((["<ul", "<li"], ["<ul", "<li"], ["<li"], ["<div"], ["<p"], [])))]
            text = " ".join([*rng.sample(said, rng.randint(0, 3) if plain else rng.random() < 0.4), *words(rng.randint(1, 3))]) + rng.choice((".", "", "")) * plain
            put(f"© {text}" if kind == "footer" and plain and rng.random() < 0.7 else text, inner, 0.0, 0.0 if kind == "form" else rng.choice((1.0, 1.0, 0.0)))

    base = ["<html", "<body"]
    wrap = [*base, *rng.choice(([], [], ["<div", *named([rng.choice(("page", "wrapper", "container", "layout"))])]))]
    first, *names = rng.choice(TEXT_IN).split() or [""]
    if manner != "telling":
        first, names = rng.choice((("div", ["x"]), ("div", ["x"]), ("div", []), ("article", []), ("main", []), ("td", []), ("section", ["x"])))
        names = named(names)
    inside = [*wrap, *(["<table", "<tr"] if first == "td" else []), *([f"<{first}"] if first else []), *(n for n in names)]
    for kind in rng.sample(("header", "menu", "notice", "advert", "form", "sidebar"), rng.randint(0, 4)):
        aside(kind, wrap)
    if rng.random() < 0.06:
        return page or [(Block(word(), tuple(base), 0), 0.0)]
    if rng.random() < 0.8:
        put(noisy(prose(rng.randint(2, 12)))[:-1], [*inside, rng.choice(("<h1", "<h1", "<h2"))], 1.0)
    for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
        kind = rng.random()
        if kind < 0.72:
            for _ in range(rng.randint(1, 3)):
                put(noisy(prose(rng.choice((1, 2, 4, 10, 30, 80, 160, 400)))), [*inside, "<p"], 1.0, 0.1 * (rng.random() < 0.2))
        elif kind < 0.78:
            put(" ".join(words(rng.randint(1, 6))), [*inside, rng.choice(("<h2", "<h3"))], 1.0)
        elif kind < 0.84:
            for _ in range(rng.randint(2, 5)):
                put(prose(rng.randint(1, 12)), [*inside, rng.choice(("<ul", "<ol")), "<li"], 1.0)
        elif kind < 0.88:
            put(prose(rng.randint(4, 40)), [*inside, rng.choice(("<blockquote", "<pre", "<figcaption"))], 1.0)
        elif kind < 0.91:
            for _ in range(rng.randint(2, 6)):
                put(" ".join(words(rng.randint(1, 4))), [*inside, "<table", "<tr", "<td"], 1.0)
        elif first:
            aside(rng.choice(("advert", "sidebar", "notice", "menu", "form")), inside)
    for kind in rng.sample(("comments", "sidebar", "footer", "advert", "form", "menu", "footer", "comments"), rng.randint(1, 4)):
        aside(kind, inside if kind == "comments" and rng.random() < 0.25 and first else wrap)
    return page


#: Blocks that are labelled together, padding included.
BATCH_BLOCKS = 20_000


def texts_of(pages: list[str | None], model: Labeller) -> list[str]:
    """The text of each page."""
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    while order:
        longest = len(cut[order[-1]])
        part = order[-max(1, BATCH_BLOCKS // longest) :]
        del order[-len(part) :]
        scores, at = model.scores([cut[i] for i in part]), 0
        for i in part:
            n = len(cut[i])
            out[i] = "\n".join(b.text for b, s in zip(cut[i], scores[at : at + n], strict=True) if s > 0)
            at += n
    return out


def extract(df: DataFrame, page: str = "page_id", source: str = "html", carry: tuple[str, ...] = ("url",), model: Labeller | None = None) -> DataFrame:
    """The page's columns in ``carry`` with its main text."""
    shared = df.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def main_text(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in frames:
            yield pd.Series([t for i in range(0, len(pages), 512) for t in texts_of(pages.iloc[i : i + 512].tolist(), shared.value)], dtype=object)

    return df.select(page, *carry, main_text(source).alias("text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
SQL: dict[str, str] = {}
