"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text within one block-level element).
Each block is read as a tag-path vector, a hashed-word vector and a few measures; a bidirectional
LSTM (numpy) sees the whole sequence and labels every block.  The text is that of the blocks
labelled as article.

The labeller is trained on layouts drawn from a rule: regions of known role (article, menu, header,
footer, sidebar, notice, advert, form, comments) in semantic tags, in plain elements with the
usual class names or without any, or in the cells of a table, filled with passages of a bounded sample
of the pages given.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.common import small_batches

#: Pages whose text fills the training layouts (chosen by a hash of page_id), words of one passage of
#: it, passages used (chosen by a hash of their text), and layouts drawn.
SAMPLE_PAGES, PASSAGE_WORDS, PASSAGES, LAYOUTS, EPOCHS = 200, 200, 4000, 1200, 10
#: Least probability of an article block.
ARTICLE = 0.45
#: Shares of layouts in semantic tags, named elements, both, unnamed elements, table cells.
STYLES = (0.3, 0.34, 0.2, 0.09, 0.07)
#: Share of training blocks whose words are hidden, so that paths and neighbours decide where words are new.
BLIND, DECAY = 0.5, 0.02
BUCKETS, WIDTH, HIDDEN = 4096, 12, 16
MEASURES = 8
#: Blocks of one vectorised run of pages.
RUN_BLOCKS = 4000

# ---------------------------------------------------------------- blocks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]{2,}")
BLOCK = frozenset("address article aside audio blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of these names, as far as the nearest of the limits.
_P_ENDS = BLOCK - frozenset("audio canvas iframe noscript object video body button caption head html label legend li dd dt optgroup option td th tr tbody thead tfoot title".split())
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",))}


class Path(Sequence):
    """Block elements from the outermost to the innermost; paths share the elements they have in common."""

    __slots__ = ("parent", "element", "depth")

    def __init__(self, parent: Path | None = None, element: str = ""):
        self.parent, self.element, self.depth = parent, element, parent.depth + 1 if parent is not None else 0

    def __len__(self) -> int:
        return self.depth

    def __iter__(self) -> Iterator[str]:
        found, at = [], self
        while at.parent is not None:
            found.append(at.element)
            at = at.parent
        return reversed(found)

    def __getitem__(self, k):
        return tuple(self)[k]

    @staticmethod
    def of(elements: Iterable[str]) -> Path:
        at = Path()
        for element in elements:
            at = Path(at, element)
        return at


class _Open:
    """The open elements, with the places of each name, so that no tag looks through all of them."""

    def __init__(self):
        self.tags: list[str] = []
        self.root = Path()
        self.paths: list[Path] = []  # of the block elements up to each place
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, element: str) -> None:
        above = self.path()
        self.places.setdefault(tag, []).append(len(self.tags))
        if element:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(Path(above, element) if element else above)

    def path(self) -> Path:
        return self.paths[-1] if self.paths else self.root

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element with one of these names, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def pop_to(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        del self.tags[k:], self.paths[k:]


def blocks(page: str) -> list[tuple[Path, str, float]]:
    """The page's leaf blocks in order: path of block elements, text, share of it within links.

    Path elements are tag names with the words of class, id and role after dots.  Character
    references are decoded, white space (``<br>`` included) becomes one blank.  Only comments, scripts, styles and templates are left out.  Time grows with the page's
    length, however deep its elements are nested and whether or not its tags end.
    """
    out: list[tuple[Path, str, float]] = []
    stack = _Open()
    text: list[str] = []
    linked: list[str] = []
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                share = len(" ".join(html.unescape("".join(linked)).split())) / len(joined) if linked else 0.0
                out.append((stack.path(), joined, min(share, 1.0)))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if stack.places.get("a"):
                linked.append(piece)

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "title" and stack.places.get("svg"):
            continue  # the name of a drawing within a line
        if m[2]:
            k = stack.last((tag,))
            if tag in BLOCK:
                flush()
            if k >= 0 and (tag in BLOCK or not (stack.blocks and stack.blocks[-1] >= k)):
                stack.pop_to(k)
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
            ends, limits = _CLOSES.get(tag, (("p",), ("td", "th", "button", "table")) if tag in _P_ENDS else ((), ()))
            k = stack.last(ends)
            if k > stack.last(limits):
                stack.pop_to(k)
        if tag in VOID or (tag not in BLOCK and m[4] and m[4].endswith("/")):
            continue
        element = ""
        if tag in BLOCK:
            names = " ".join("".join(x) for x in _NAMES.findall(m[4])).lower() if m[4] else ""
            element = ".".join([tag, *_PARTS.findall(names), *(["hidden"] if m[4] and _HIDDEN.search(m[4]) else [])])
        stack.push(tag, element)
    add(page[at:])
    flush()
    return out


# ---------------------------------------------------------------- features


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


class Features:
    """Bucket numbers of paths and words, remembered between pages.

    A path has a number, found from its parent's number and its own element.  For each number stand the
    three innermost tags and the buckets of all else: tags and names anywhere on the path, tags further out.
    """

    def __init__(self):
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.near: list[tuple[str, ...]] = [()]
        self.far: list[frozenset[int]] = [frozenset()]
        self.lists: list[list[int]] = [[]]
        self.merged: dict[tuple[int, tuple[str, ...]], list[int]] = {}

    def path(self, path: Path, known: dict[int, int]) -> int:
        """The number of a path; ``known`` holds those of the page's other paths (by identity)."""
        chain, at = [], path
        while at.parent is not None and id(at) not in known:
            chain.append(at)
            at = at.parent
        number = known.get(id(at), 0)
        for step in reversed(chain):
            found = self.numbers.get((number, step.element))
            known[id(step)] = number = self._add(number, step.element) if found is None else found
        return number

    def _add(self, parent: int, element: str) -> int:
        tag, *names = element.split(".")
        near, far = (tag, *self.near[parent])[:4], self.far[parent]
        more = {_bucket(f"in:{tag}"), *(_bucket(f"name:{w}") for w in names), *(_bucket(f"3:{t}") for t in near[3:])}
        near = near[:3]
        if not more <= far:
            far = far | more
        self.near.append(near)
        self.far.append(far)
        made = self.merged.get((id(far), near))
        if made is None:
            made = self.merged[id(far), near] = sorted(far | {_bucket(f"{k}:{t}") for k, t in enumerate(near)})
        self.lists.append(made)
        number = self.numbers[parent, element] = len(self.near) - 1
        return number

    def word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > 200_000:
                self.words.clear()
            found = self.words[word] = zlib.crc32(word.lower().encode("utf-8", "replace")) % BUCKETS
        return found

    def of(self, page: list[tuple[Path, str, float]]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        paths, words, measures = [], [], np.zeros((len(page), MEASURES), np.float32)
        known: dict[int, int] = {}
        if len(self.near) > 20_000:
            self.forget()
        for k, (path, text, share) in enumerate(page):
            own = text.split()
            paths.append(self.lists[self.path(path, known)])
            words.append(list(map(self.word, own)))
            n = len(own)
            measures[k] = (np.log1p(n) / 4, share, min(n, 5) / 5, text[-1] in ".!?:\"'…", text[0] in "©&|•·»", (k + 1) / len(page), len(path) / 8, len(text) / n / 10)
        return paths, words, measures


# ---------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _bag(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    """Mean of the table's rows for each list of buckets; a list that is there more than once is summed once."""
    _, first, place = np.unique(np.fromiter(map(id, lists), np.int64, len(lists)), return_index=True, return_inverse=True)
    size = np.array([len(lists[k]) for k in first], dtype=np.int64)
    out = np.zeros((len(first), table.shape[1]), table.dtype)
    ends, start = np.cumsum(size), 0
    while start < len(first):  # about a million buckets at a time
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + 1_000_000)))
        full = np.flatnonzero(size[start:end]) + start
        if len(full):
            flat = np.concatenate([np.asarray(lists[first[k]], dtype=np.int64) for k in full])
            out[full] = np.add.reduceat(table[flat], np.concatenate([[0], np.cumsum(size[full])[:-1]]), axis=0) / size[full, None]
        start = end
    return out[place]


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence of a (time, page, ...) batch turned round within its own length."""
    t = np.arange(len(x))[:, None]
    return x[np.where(t < lengths, lengths - 1 - t, t), np.arange(len(lengths))]


class Labeller:
    """Embeddings, one LSTM for each direction and a logistic output."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        inputs = 2 * WIDTH + MEASURES
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"path": np.zeros((BUCKETS, WIDTH), np.float32), "word": np.zeros((BUCKETS, WIDTH), np.float32), "out": w(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(inputs, 4 * HIDDEN), f"U{d}": w(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray]:
        """A (time, page, feature) batch, padded, and the pages' lengths."""
        lengths = np.array([len(m) for _, _, m in pages])
        flat = np.concatenate([_bag(self.p["path"], [x for p in pages for x in p[0]]), _bag(self.p["word"], [x for p in pages for x in p[1]]), np.concatenate([m for _, _, m in pages])], axis=1)
        x = np.zeros((lengths.max(), len(pages), flat.shape[1]), np.float32)
        x[np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(pages)), lengths)] = flat
        return x, lengths

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        u, zx = self.p[f"U{d}"], x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)):
            z = zx[t] + h @ u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, before, was, tc))
        return out, tape

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        hf, tf = self._run(x, "f", keep)
        xb = _reverse(x, lengths)
        hb, tb = self._run(xb, "b", keep)
        h = np.concatenate([hf, _reverse(hb, lengths)], axis=2)
        return _sigmoid(h @ self.p["out"] + self.p["bias"]), h, (tf, tb, xb)

    def predict(self, pages: list) -> list[np.ndarray]:
        """Article probabilities of each page's blocks; pages of like lengths run together."""
        result: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k][2])), key=lambda k: len(pages[k][2]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end + 1 - start) * len(pages[order[end]][2]) <= RUN_BLOCKS:
                end += 1
            x, lengths = self.inputs([pages[k] for k in order[start:end]])
            p = self.forward(x, lengths)[0]
            for column, k in enumerate(order[start:end]):
                result[k] = p[: lengths[column], column]
            start = end
        return result

    def _gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, lengths = self.inputs(pages)
        p, h, (tf, tb, xb) = self.forward(x, lengths, keep=True)
        y = np.zeros_like(p)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        mask = np.arange(len(x))[:, None] < lengths
        err = np.where(mask, p - y, 0).astype(np.float32) / mask.sum()
        g = {"out": np.einsum("tn,tnh->h", err, h), "bias": np.array([err.sum()], np.float32)}
        dh = err[:, :, None] * self.p["out"]
        dx = np.zeros_like(x)
        for d, own, tape, grad in (("f", x, tf, dh[:, :, :HIDDEN]), ("b", xb, tb, _reverse(dh[:, :, HIDDEN:], lengths))):
            u = self.p[f"U{d}"]
            dz, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
            nh = nc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                i, f, o, gg, before, was, tc = tape[t]
                live = mask[t][:, None]
                dh_t = np.where(live, grad[t] + nh, 0)
                dc = np.where(live, nc + dh_t * o * (1 - tc * tc), 0)
                dz[t] = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh_t * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                du += was.T @ dz[t]
                nh, nc = dz[t] @ u.T, dc * f
            g |= {f"U{d}": du, f"W{d}": np.einsum("tni,tnz->iz", own, dz), f"c{d}": dz.sum((0, 1))}
            back = dz @ self.p[f"W{d}"].T
            dx += back if d == "f" else _reverse(back, lengths)
        flat = dx[np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(pages)), lengths)]
        for name, part, lists in (("path", flat[:, :WIDTH], [q for s in pages for q in s[0]]), ("word", flat[:, WIDTH : 2 * WIDTH], [q for s in pages for q in s[1]])):
            g[name] = np.zeros_like(self.p[name])
            size = np.array([len(q) for q in lists])
            rows = np.repeat(np.arange(len(lists)), size)
            np.add.at(g[name], np.array([b for q in lists for b in q], dtype=np.int64), part[rows] / size[rows, None])
        return g

    def fit(self, pages: list, labels: list[np.ndarray], seed: int = 5, batch: int = 40, rate: float = 0.015) -> None:
        """Adam over ``EPOCHS`` epochs, at a pace that falls to a tenth; batches hold pages of like lengths."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order, step = np.argsort([len(x) for x in labels], kind="stable"), 0
        batches = [order[k : k + batch] for k in range(0, len(order), batch)]
        for _ in range(EPOCHS):
            for k in r.permutation(len(batches)):
                step += 1
                for name, grad in self._gradients([pages[j] for j in batches[k]], [labels[j] for j in batches[k]]).items():
                    grad = np.clip(grad, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.99 * v[name] + 0.01 * grad * grad
                    pace = rate * (1 - 0.9 * step / (EPOCHS * len(batches)))
                    if name == "word":  # words of the pool say nothing of a block's role: only steady evidence stays
                        pace *= 0.3
                        self.p[name] *= 1 - DECAY
                    self.p[name] -= (pace * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


# ---------------------------------------------------------------- training layouts

#: Usual class names and phrases of each role.
NAMES = {
    "main": "content main article post entry story body text maincontent single blog news read",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs links categories pager pagination",
    "header": "header masthead top logo branding site brand topbar",
    "footer": "footer bottom copyright colophon legal foot sitefooter imprint",
    "side": "sidebar side aside widget related recommended rail trending popular more teaser archive",
    "ad": "ad ads advert advertisement sponsor sponsored promo adsense advertising banner",
    "notice": "cookie notice consent gdpr alert popup modal overlay paywall toast cookies privacy announcement",
    "comments": "comments comment discussion replies respond disqus thread reply feedback commentlist reader",
    "form": "form search login signup subscribe newsletter contact register",
    "share": "share social sharing tags author bio meta",
}
PHRASES = {
    "nav": "Home|About|News|Contact|Archive|Products|Blog|Menu|Next|Previous",
    "header": "Welcome|Daily News|The Journal|Skip to content",
    "footer": "© 2024 All rights reserved.|Copyright 2024|Privacy policy|Terms of use|Imprint|Powered by|©",
    "side": "Related posts|Most read|Popular|You may also like|Trending|Newest",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Save 50%",
    "notice": "We use cookies to improve this site.|Accept all|This site uses cookies.|Subscribe to read on.|Please enable JavaScript.",
    "comments": "3 comments|Reply|says:|Leave a comment|Posted by|Anonymous wrote:|Report",
    "form": "Search|Your email|Sign in|Password|Send|Submit|Name",
    "share": "Share|Tweet|Tags:|Follow us|About the author",
}
_TAGS = {"main": ("article", "main", "section", "div"), "nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "aside", "dialog"), "comments": ("section", "div", "ol", "aside"), "form": ("form", "div"), "share": ("div", "ul")}


def layout(r: np.random.Generator, pool: list[str]) -> tuple[list, np.ndarray]:
    """One page's blocks and labels: regions in a usual order, with semantic tags, named or unnamed elements, or table cells."""
    style = r.choice(["semantic", "named", "mixed", "bare", "table"], p=STYLES)
    pick = lambda x: x[int(r.integers(len(x)))]

    def words(low: int, high: int) -> str:
        n, out = int(r.integers(low, high + 1)), []
        while len(out) < n:
            own = pick(pool).split()
            at = int(r.integers(max(len(own) - 3, 1)))
            out += own[at : at + n - len(out)]
        return " ".join(out)

    def element(role: str) -> str:
        tags = _TAGS[role]
        if style in ("bare", "table"):
            return "form" if role == "form" and r.random() < 0.7 else "div" if style == "bare" else "td"
        tag = tags[0] if style == "semantic" or (style == "mixed" and r.random() < 0.5) else pick(tags[1:])
        if style == "semantic" and role in ("ad", "notice", "share", "comments") or tag in ("div", "section", "ul", "ol", "dialog") or r.random() < 0.4:
            return ".".join([tag, *{pick(NAMES[role].split()) for _ in range(int(r.integers(1, 3)))}])
        return tag

    root = ("html", "body", "table", "tr") if style == "table" else ("html", "body")
    for _ in range(0 if style == "table" else int(r.integers(0, 3))):
        root += ("div",) if style == "bare" else (pick(["div", "div.wrapper", "div.container", "div.page", "div.layout", "div.row", "div.col"]),)
    out: list[tuple[tuple[str, ...], str, float, int]] = [(("html", "head", "title"), words(3, 14), 0.0, 0)]

    def put(path: tuple[str, ...], text: str, link: float, label: int = 0) -> None:
        out.append((path, text, link, label))

    def phrase(role: str, low: int, high: int) -> str:
        return pick(PHRASES[role].split("|")) if r.random() < 0.4 else words(low, high)

    def listed(base: tuple[str, ...], role: str, low: int, high: int, n: int) -> None:
        shape = pick([("ul", "li"), ("div",), (), ("ul.menu", "li.item"), ("ol", "li"), ("p",)])
        for _ in range(n):
            put(base + shape, phrase(role, low, high), 1.0 if r.random() < 0.9 else 0.0)

    def boilerplate(role: str, base: tuple[str, ...]) -> None:
        base += (element(role),)
        if role == "nav" and r.random() < (0.5 if style in ("bare", "table") else 0.25):  # all links in one line
            put(base, " ".join(phrase(role, 1, 2) for _ in range(int(r.integers(2, 7)))), 0.9 + 0.1 * float(r.random()))
        elif role == "nav":
            listed(base, role, 1, 3, int(r.integers(2, 9)))
        elif role == "header":
            put(base + (pick(["h1", "p", "div", "div.logo", "h2"]),), phrase(role, 1, 6), float(r.random() < 0.5))
            if r.random() < 0.5:
                put(base + ("p",), words(3, 12), 0.0)
        elif role == "footer":
            put(base + pick([(), ("p",), ("div",)]), phrase(role, 2, 25), float(r.random() < 0.2))
            if r.random() < 0.5:
                listed(base, role, 1, 3, int(r.integers(1, 6)))
        elif role == "side":
            put(base + (pick(["h2", "h3", "h4", "p"]),), phrase(role, 1, 5), 0.0)
            if r.random() < 0.6:
                listed(base, role, 2, 12, int(r.integers(1, 7)))
            for _ in range(int(r.integers(0, 3))):
                put(base + (pick(["p", "div", "li"]),), words(6, 45), float(r.random() < 0.2))
        elif role in ("ad", "notice", "share"):
            for _ in range(int(r.integers(1, 3))):
                put(base + pick([(), ("p",), ("div",), ("button",)]), phrase(role, 2, 30), float(r.random() < 0.3))
        elif role == "comments":
            bare = style in ("bare", "table")  # only words tell
            if bare or r.random() < 0.7:
                put(base + (pick(["h2", "h3", "p"]),), f"{int(r.integers(1, 99))} comments" if bare and r.random() < 0.5 else phrase(role, 1, 4), 0.0)
            item = pick([(), ("div",), ("div", "p"), ("p",)] if bare else [(), ("div.comment",), ("li", "p"), ("article", "p"), ("li.comment", "div"), ("div", "p"), ("p",)])
            for _ in range(int(r.integers(1, 6))):
                if r.random() < (0.8 if bare else 0.4):
                    by = f"{words(1, 2)} {pick(['says:', 'wrote:', 'replied:'])}" if r.random() < 0.5 else phrase(role, 1, 3)
                    put(base + item[:1] + (pick(["cite", "div" if bare else "div.meta", "p", "header"]),), by, 0.0)
                put(base + item, words(3, 60), 0.0)
        else:
            for _ in range(int(r.integers(1, 5))):
                put(base + pick([("label",), ("button",), ("option",), ("p",), ("fieldset", "label"), ("select", "option"), ()]), phrase(role, 1, 6), 0.0)

    def maybe(role: str, chance: float, base: tuple[str, ...]) -> None:
        if r.random() < chance:
            boilerplate(role, base)

    for role, chance in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("form", 0.15), ("ad", 0.4)):
        maybe(role, chance, root)
    if r.random() < 0.25:
        boilerplate("side", root)
    base = root + (element("main"),)
    for role, chance in (("nav", 0.06), ("ad", 0.06)):
        maybe(role, chance, base)
    inner = base
    for _ in range(int(r.integers(0, 3)) if r.random() < 0.5 else 0):
        inner += (element("main") if r.random() < 0.6 else "div",)
    if r.random() < 0.85:
        put(inner + (("header", "h1") if r.random() < 0.1 else (pick(["h1", "h1", "h2"]),)), words(2, 14), 0.0, 1)
    long = r.random() < 0.2  # many short lines
    n = int(r.integers(20, 80)) if long else int(r.integers(1, 5)) if r.random() < 0.3 else int(r.integers(2, 22))
    leaf = pick(["p", "p", "p", "div", ""])
    short = 0.9 if long else 0.3
    for k in range(n):
        kind = r.random()
        if kind < 0.8:
            put(inner + ((leaf,) if leaf else ()), words(1, 4 if long else 12) if r.random() < short else words(8, 90), 0.0 if r.random() < 0.85 else float(r.random()), 1)
        elif kind < 0.87:
            put(inner + (pick(["h2", "h3", "h4"]),), words(1, 8), 0.0, 1)
        elif kind < 0.93:
            for _ in range(int(r.integers(1, 5))):
                put(inner + (pick(["ul", "ol"]), "li"), words(1, 20), float(r.random() < 0.1), 1)
        elif kind < 0.96:
            put(inner + (pick(["blockquote", "pre", "figure"]), pick(["p", "figcaption"])), words(3, 40), 0.0, 1)
        elif kind < 0.98:
            put(inner + ("table", "tr", "td"), words(1, 6), 0.0, 1)
        else:
            boilerplate(pick(["ad", "share", "form", "notice"]), inner)
    for role, chance in (("share", 0.2), ("footer", 0.05), ("comments", 0.12), ("side", 0.06)):
        maybe(role, chance, base)
    for role, chance in (("comments", 0.3), ("side", 0.35), ("form", 0.12), ("ad", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.15)):
        maybe(role, chance, root)
    return [(Path.of(x[0]), *x[1:3]) for x in out], np.array([x[3] for x in out], np.float32)


def train(pool: list[str], seed: int = 5) -> Labeller:
    """A labeller trained on ``LAYOUTS`` layouts filled from ``pool``."""
    r, features, model = np.random.default_rng(seed), Features(), Labeller(seed)
    pool = [x for x in pool if len(x.split()) > 3] or ["one two three four five six seven eight nine ten"]
    made = [layout(r, pool) for _ in range(LAYOUTS)]
    read = [features.of(x) for x, _ in made]
    read = [(p, [[] if r.random() < BLIND else w for w in words], m) for p, words, m in read]
    model.fit(read, [y for _, y in made], seed)
    return model


# ---------------------------------------------------------------- Spark


def fit(pages: DataFrame) -> Labeller:
    """Trains on at most ``PASSAGES`` passages of the text of at most ``SAMPLE_PAGES`` pages.

    The whole text of the pages is cut into passages where it lies, and a hash chooses among all of
    them, so that long pages and blocks count with all they hold.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text.split() for page in b.column(0).to_pylist() for _, text, share in blocks(page) if share < 0.5]
            cut = [" ".join(x[k : k + PASSAGE_WORDS]) for x in found for k in range(0, len(x), PASSAGE_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string())], ["passage"])

    rows = pages.select(F.col("page_id").cast("string").alias("id"), F.col("html").cast("string").alias("html")).where("html IS NOT NULL")
    ids = rows.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES)
    sample = rows.join(F.broadcast(ids), "id").select("html").mapInArrow(run, "passage string").distinct()
    return train([r["passage"] for r in sample.orderBy(F.xxhash64("passage"), "passage").limit(PASSAGES).collect()])


def main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of text).

    Blocks labelled as article are joined in page order by one line feed; a page without any, and
    null or empty html, has an empty text.  Every block of every page is labelled, however long.
    An empty table gives no rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [blocks(x or "") for x in b.column(2).to_pylist()]
            chance = held.value.predict([features.of(x) for x in found])
            texts = ["\n".join(x[1] for x, p in zip(page, own) if p >= ARTICLE) for page, own in zip(found, chance)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
