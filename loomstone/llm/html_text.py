"""HTML extraction (operator 2): a recurrent block labeller.

A page becomes its sequence of text blocks. Each block has a vector of its tag
path (tags, classes, ids and roles of all open elements, outer ones fading), of
its hashed words and of measures of itself, its container and the page; a
bidirectional LSTM in numpy reads the whole sequence and says of every block
whether it belongs to the article. The network is small and trained at first use
on generated pages of many layouts with known labels, always from the same seed;
its weights (some 200 kB, whatever the tables' size) are broadcast.

Parsing takes time and memory in proportion to a page's length: open elements
are nodes of a tree that all blocks share, and their vectors come from their
parents'.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm.common import map_columns, table
from loomstone.llm.words import ALNUM, chunks

PATH_DIM, WORD_DIM, MEASURES = 128, 48, 15
DIM = PATH_DIM + WORD_DIM + MEASURES
FADE = 0.8  # of an outer element's part in a path vector, for each element inside it
HIDDEN = 24
TRAIN_PAGES = 4200
EPOCHS = 5
STEP_CELLS = 12_000  # blocks in one padded batch of sequences

#: the most frequent function words of English, German, French, Spanish
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ou "
    "el y los se del las por con no una su para es al lo como o pero sus le ha me si sin sobre este"
).split()

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg math xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: a start tag closes an open element of these names first
CLOSES = {t: frozenset({"p"}) for t in BLOCK - {"button", "label", "option", "td", "th", "tr"}} | {
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
INLINE = frozenset("a b em i span strong".split())
_SCOPE = frozenset("ul ol dl table div section article body nav aside form".split())
_IN_HEAD = frozenset("html head title".split())

_TOKEN = re.compile(r"<!--|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Text blocks in page order, and the tree of the block elements that hold them."""

    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, characters inside links
    nodes: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])  # parent, label; node 0 is the page


def blocks_of(html: str) -> Page:
    """The text blocks of a page; text in the head is none."""
    page = Page()
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = [("", 0)]  # open elements: name, node
    open_: dict[str, list[int]] = {}  # their places in the stack
    scopes: list[int] = [0]
    parts: list[str] = []
    linked, at, end = 0, 0, len(html)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not open_.get("title") and not open_.get("head"):
                page.blocks.append((stack[-1][1], text, linked))
            parts, linked = [], 0

    def pop(name: str) -> None:
        while len(stack) > 1:
            gone = stack.pop()[0]
            open_[gone].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            if gone == name:
                return

    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            said = m.group()
            if said == "<!--":
                stop = html.find("-->", at)
                at = end if stop < 0 else stop + 3
            elif said[0] != "<" or said == "<":
                parts.append(said)
                if open_.get("a"):
                    linked += len(said)
            continue
        name, rest = name.lower(), m.group(3) or ""
        if m.group(1):
            if name == "br":
                parts.append(" ")
            elif open_.get(name):
                if name in BLOCK:
                    flush()
                pop(name)
            continue
        empty = rest.rstrip().endswith("/")
        if name in RAW:
            if not empty:
                stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
                at = end if stop is None else (html.find(">", stop.end()) + 1 or end)
            continue
        if name in BLOCK:
            flush()
            if open_.get("head") and name not in _IN_HEAD:
                pop("head")
            for old in CLOSES.get(name, ()):
                if open_.get(old) and open_[old][-1] > scopes[-1]:
                    pop(old)
        elif name == "br":
            parts.append(" ")
        if name in VOID or empty or not (name in BLOCK or name in INLINE):
            continue
        node = stack[-1][1]
        if name in BLOCK:
            names = [x for found in _NAMES.findall(rest) for part in found if part for x in _PARTS.findall(part)] if rest else []
            key = (node, " ".join([name, *names]))
            if key not in known:
                known[key] = len(page.nodes)
                page.nodes.append(key)
            node = known[key]
        open_.setdefault(name, []).append(len(stack))
        if name in _SCOPE:
            scopes.append(len(stack))
        stack.append((name, node))
    flush()
    return page


def _label_vector(label: str) -> np.ndarray:
    """Signed hashed counts of an element's tag and of the parts of its names."""
    v = np.zeros(PATH_DIM, dtype=np.float32)
    tag, *names = label.split(" ")
    for word in {tag, *(f".{w.lower()}" for w in names)}:
        for salt in (zlib.crc32(word.encode()), zlib.crc32(b"#" + word.encode())):
            v[salt % PATH_DIM] += 1.0 if (salt >> 16) & 1 else -1.0
    return v


@lru_cache(maxsize=1)
def _function_words() -> np.ndarray:
    return np.unique(np.concatenate([c.hash for c in chunks(pa.array([" ".join(FUNCTION_WORDS)], pa.large_string()), ALNUM)]))


def _tree_sums(page: Page, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node: the sum of ``values`` of its own blocks, and of its whole subtree."""
    own = np.bincount([b[0] for b in page.blocks], weights=values, minlength=len(page.nodes))
    total = own.copy()
    for i in range(len(page.nodes) - 1, 0, -1):  # children come after their parents
        total[page.nodes[i][0]] += total[i]
    return own, total


def vectors(pages: list[Page]) -> np.ndarray:
    """One row for each block of all pages."""
    texts = [b[1] for page in pages for b in page.blocks]
    x = np.zeros((len(texts), DIM), dtype=np.float32)
    if not texts:
        return x
    words, common = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for c in chunks(pa.array(texts, pa.large_string()), ALNUM):
        rows = c.row_of + c.first
        slot = (c.hash % np.uint64(WORD_DIM)).astype(np.int64)
        sign = np.where((c.hash >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        np.add.at(x, (rows, PATH_DIM + slot), sign.astype(np.float32))
        words += np.bincount(rows, minlength=len(texts))
        common += np.bincount(rows[np.isin(c.hash, _function_words())], minlength=len(texts))
    x[:, PATH_DIM : PATH_DIM + WORD_DIM] /= np.sqrt(np.maximum(1, words))[:, None]
    size = np.array([len(t) for t in texts], dtype=np.float64)
    links = np.array([b[2] for page in pages for b in page.blocks], dtype=np.float64)
    m = x[:, PATH_DIM + WORD_DIM :]
    m[:, 0] = np.log1p(size) / 5
    m[:, 1] = np.log1p(words) / 4
    m[:, 2] = np.minimum(1, links / size)
    m[:, 3] = [t[-1] in ".!?:…\"”»" for t in texts]
    m[:, 4] = [sum(map(t.count, ".,")) / len(t) * 10 for t in texts]
    m[:, 5] = common / np.maximum(1, words) * 2
    m[:, 6] = 1
    labels: dict[str, np.ndarray] = {}
    at = 0
    for page in pages:
        n = len(page.blocks)
        if not n:
            continue
        here, node = slice(at, at + n), np.array([b[0] for b in page.blocks])
        parent = np.array([p for p, _ in page.nodes])
        v = np.zeros((len(page.nodes), PATH_DIM), dtype=np.float32)
        for i, (up, label) in enumerate(page.nodes[1:], 1):
            if label not in labels:
                labels[label] = _label_vector(label)
            v[i] = FADE * v[up] + labels[label]
        x[here, :PATH_DIM] = v[node]
        own, whole = _tree_sums(page, size[here])
        linked = _tree_sums(page, links[here])[1]
        count = _tree_sums(page, np.ones(n))[1]
        up, total = parent[node], size[here].sum()
        m[here, 7] = np.linspace(0, 1, n)
        m[here, 8] = own[node] / total
        m[here, 9] = whole[up] / total
        m[here, 10] = whole[parent[up]] / total
        m[here, 11] = size[here] / size[here].max()
        m[here, 12] = np.minimum(1, linked[up] / np.maximum(1, whole[up]))
        m[here, 13] = np.log1p(whole[up] / np.maximum(1, count[up])) / 5
        m[here, 14] = [page.nodes[i][1][:2] in ("h1", "h2", "h3", "h4", "h5", "h6") for i in node]
        at += n
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BiLSTM:
    """A bidirectional LSTM with a logistic output for each step."""

    def __init__(self, dim: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden, 1)).astype(np.float32)
        self.w["oc"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        b, t, _ = x.shape
        n = self.h
        z = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out, tape = np.zeros((b, t, n), np.float32), []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[:, s] + h @ self.w[f"h{d}"]
            i, f, o, u = _sigmoid(g[:, :n]), _sigmoid(g[:, n : 2 * n]), _sigmoid(g[:, 2 * n : 3 * n]), np.tanh(g[:, 3 * n :])
            m = mask[:, s, None]
            c2 = (f * c + i * u) * m
            th = np.tanh(c2)
            h2 = o * th * m
            if keep:
                tape.append((s, h, c, i, f, o, u, th, m))
            h, c = h2, c2
            out[:, s] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["oc"]), both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, both, tf, tb = self.forward(x, mask, keep=True)
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total)
        dz = ((p - y) * mask / total).astype(np.float32)
        g = {"o": np.tensordot(both, dz, ([0, 1], [0, 1]))[:, None], "oc": np.array([dz.sum()])}
        dboth = dz[:, :, None] * self.w["o"][:, 0]
        n = self.h
        for d, tape, dout in (("f", tf, dboth[:, :, :n]), ("b", tb, dboth[:, :, n:])):
            gx, gh, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"h{d}"]), np.zeros_like(self.w[f"c{d}"])
            dh, dc = np.zeros((len(x), n), np.float32), np.zeros((len(x), n), np.float32)
            for s, h, c, i, f, o, u, th, m in reversed(tape):
                dh = (dh + dout[:, s]) * m
                dc = (dc + dh * o * (1 - th * th)) * m
                dg = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                gx += x[:, s].T @ dg
                gh += h.T @ dg
                gc += dg.sum(axis=0)
                dh, dc = dg @ self.w[f"h{d}"].T, dc * f
            g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        return g, loss

    def fit(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float = 0.012) -> float:
        """Adam over the padded batches, ever slower; returns the last epoch's mean loss."""
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            losses, pace = [], rate * (1 - 0.9 * epoch / epochs)
            for x, mask, y in batches:
                g, one = self.gradients(x, mask, y)
                losses.append(one)
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.w[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss


def padded(pages: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of sequences of like lengths: (their places, values, mask)."""
    order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= STEP_CELLS:
            to += 1
        part = order[at:to]
        t = len(pages[part[-1]])
        x, mask = np.zeros((len(part), t, pages[part[0]].shape[1]), np.float32), np.zeros((len(part), t), np.float32)
        for row, i in enumerate(part):
            x[row, : len(pages[i])] = pages[i]
            mask[row, : len(pages[i])] = 1
        yield part, x, mask
        at = to


# ---- generated training pages -------------------------------------------------------------------------------------

_LETTERS = ("b c d f g h k l m n p r s t v w z br ch cl cr dr fl gr pl pr sc sh sp st tr th".split(), "a e i o u y ai ea ie oo ou ä é ö ü".split())
_MARK = "①"
_MAIN = "content main post article body text story entry page-content post-body entry-content article-text main-content bodyContent mw-content-text story_body postText primary hentry single reader".split()
_PLAIN = "wrap wrapper container row col inner outer page layout box grid x1 c12 left center block section group".split()
_CUES = {
    "menu": "Home|About us|Contact|News|Products|Services|Blog|FAQ|Log in|Sign up|Archive|Search|Shop|Team|Jobs|Help|Startseite|Über uns|Kontakt|Accueil|À propos|Inicio|Contacto|Next|Previous|Skip to content",
    "foot": "All rights reserved|Privacy policy|Terms of use|Imprint|Impressum|Datenschutz|Mentions légales|Aviso legal|Powered by|Site map|Cookie settings|Follow us|Back to top|Alle Rechte vorbehalten|Tous droits réservés",
    "notice": "We use cookies to improve this site.|Accept all cookies|Subscribe to our newsletter|Sign up for updates|Please enable JavaScript|This site is under maintenance|Wir verwenden Cookies.|Nous utilisons des cookies.|Usamos cookies.|You have read all your free articles.",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Anzeige|Publicité|Publicidad|Order today|Free shipping|Up to 50% off|Promoted",
    "side": "Related articles|Most read|Popular posts|Recent posts|You may also like|Trending|More from this section|Mehr zum Thema|À lire aussi|Archives",
    "comments": "Comments|Leave a reply|Reply|says:|3 comments|Kommentare|Commentaires|Log in to comment|Report",
    "share": "Share this|Tweet|Posted in|Tags:|Categories:|Filed under|By the editors|Print|E-mail this|2 min read",
}
_CUES = {k: v.split("|") for k, v in _CUES.items()}
_NAMED = {
    "menu": "menu nav navbar topnav navigation links main-menu site-nav mainMenu",
    "foot": "footer site-footer bottom foot copyright legal colophon pageFooter",
    "notice": "cookie cookie-notice notice alert gdpr consent newsletter subscribe popup paywall disclaimer banner-notice",
    "ad": "ad ads advert advertisement ad-slot adbox sponsored promo banner adsense",
    "side": "sidebar side widget related recommended trending aside related-posts side-column sideBar",
    "comments": "comments comment-list commentlist reader-comments responses discussion thread",
    "share": "share social meta byline tags breadcrumb breadcrumbs pagination post-meta catlinks",
    "head": "header site-header masthead top branding pageHeader logo",
}
_NAMED = {k: v.split() for k, v in _NAMED.items()}


@lru_cache(maxsize=1)
def _lexicon() -> list[str]:
    """Invented words of two to seven sounds."""
    rng = random.Random(5)
    return ["".join(rng.choice(_LETTERS[i % 2]) for i in range(rng.randrange(2, 8))) for _ in range(8000)]


class _Writer:
    """One generated page: its language, its habits and the parts it is made of."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.function = rng.random() < 0.75
        self.language = rng.randrange(4)
        self.loose = rng.random() < 0.25  # leaves out end tags
        self.short = rng.random() < 0.45  # a page of few and short blocks
        self.style = rng.choice(["plain"] * 6 + ["caps", "marks", "again", "digits", "pipes"])

    def pick(self, xs):
        return xs[int(self.rng.random() * len(xs))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def word(self) -> str:
        if self.function and self.chance(0.42):
            cuts = (0, 59, 105, 136, len(FUNCTION_WORDS))
            return FUNCTION_WORDS[self.rng.randrange(cuts[self.language], cuts[self.language + 1])]
        return self.pick(_lexicon())

    def prose(self, low: int, high: int) -> str:
        n = self.rng.randrange(low, high)
        words = [self.word() for _ in range(n)]
        if self.style == "caps":
            words = [w.upper() + "!" * int(self.chance(0.3)) for w in words]
        elif self.style == "marks":
            signs = "~^=+_*#@%$&".replace("&", "§")
            words = [w + self.pick(signs) * 2 if self.chance(0.5) else w for w in words]
        elif self.style == "again":
            words = [words[i % self.rng.choice((1, 3))] for i in range(n)] if self.chance(0.5) else words[:1] * n
        elif self.style == "digits":
            words = [str(self.rng.randrange(100_000)) if self.chance(0.4) else w for w in words]
        elif self.style == "pipes":
            words = [x for w in words for x in (w, self.pick("|/-"))]
        out, fresh = [], True
        for w in words:
            w = w[:1].upper() + w[1:] if fresh else w
            fresh = self.chance(0.1)
            out.append(w + ("." if fresh else "," if self.chance(0.07) else ""))
        return " ".join(out).rstrip(",.") + ("." if self.chance(0.8) else "")

    def open(self, tag: str, names: list[str] | str = "") -> str:
        name = names if isinstance(names, str) else self.pick(names)
        kind = self.pick(["class", "class", "id"])
        return f'<{tag} {kind}="{name}">' if name else f"<{tag}>"

    def element(self, tag: str, names: list[str] | str, inner: str) -> str:
        return self.open(tag, names) + inner + f"</{tag}>"

    def close(self, tag: str) -> str:
        return "" if self.loose and tag in ("p", "li", "td", "tr") and self.chance(0.7) else f"</{tag}>"

    def links(self, low: int, high: int, cues: str = "menu") -> list[str]:
        said = lambda: self.pick(_CUES[cues]) if self.chance(0.6) else self.prose(1, 5).rstrip(".")
        return [f'<a href="/{i}">{said()}</a>' for i in range(self.rng.randrange(low, high))]

    def listed(self, items: list[str]) -> str:
        return "<ul>" + "".join(f"<li>{x}{self.close('li')}" for x in items) + "</ul>"

    def menu(self) -> str:
        items = self.links(2, 9)
        inner = self.pick([self.listed(items), self.pick([" ", " | ", " · ", "<br>"]).join(items), self.listed([x.split(">")[1][:-3] for x in items])])
        return self.pick([f"<nav>{inner}</nav>", self.element("div", _NAMED["menu"], inner), self.element("div", "", inner), f"<header><nav>{inner}</nav></header>", inner if inner.startswith("<ul") else f"<p>{inner}</p>", self.element("ul", _NAMED["menu"], inner[4:-5]) if inner.startswith("<ul") else f"<div>{inner}</div>"])

    def junk(self, kind: str, inside: bool = False) -> str:
        cue = self.pick(_CUES[kind])
        said = self.pick([cue, f"{cue} {self.prose(1, 14)}", self.prose(2, 30)])
        if inside and said[:4] not in cue:
            said = cue
        if kind == "comments":
            one = lambda: self.element(self.pick(["div", "li", "article"]), ["comment", "comment-body", "reply", ""], f"<b>{self.prose(1, 3)}</b> " + self.pick(["{}", "<p>{}</p>"]).format(self.prose(2, 40)))
            inner = f"<h3>{cue}</h3>" + "".join(one() for _ in range(self.rng.randrange(1, 5)))
        elif kind in ("side", "share") and self.chance(0.6):
            items = self.links(2, 7, kind)
            inner = self.pick(["", f"<h3>{cue}</h3>", f"<p>{cue}</p>"]) + self.pick([self.listed(items), ", ".join(items)])
        else:
            inner = self.pick(["{}", "<p>{}</p>", "<span>{}</span>", "{} <button>OK</button>", "<h4>{}</h4><p>" + self.prose(2, 9) + "</p>"]).format(said)
        names = _NAMED[kind] if inside or self.chance(0.8) else ""
        tags = {"side": ["aside", "div", "div", "section"], "comments": ["section", "div"], "notice": ["div", "p", "section"], "ad": ["div", "div", "aside", "p"]}.get(kind, ["div", "div", "p"])
        tag = self.pick(tags)
        return self.element("div" if tag == "p" and "<" in inner.replace("<span", "").replace("</span", "") else tag, names, inner)

    def form(self) -> str:
        return self.element("form", ["", "search", "login", "comment-form"], f"<label>{self.prose(1, 3)}</label><input name=q><select><option>{self.prose(1, 2)}</option></select><button>{self.pick(['Go', 'Send', 'OK'])}</button>")

    def block(self, link: bool = True) -> str:
        text = _MARK + self.prose(*((6, 26) if self.short else (1, 80)) if self.chance(0.8) else (1, 6))
        kinds = [f"<p>{text}{self.close('p')}"] * 8 + [f"<h2>{text}</h2>", f"<h3>{text}</h3>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", f"<div>{text}</div>"]
        kinds += [f"<p>{text} <em>{self.prose(1, 4)}</em> <a href=/y>{self.prose(1, 4)}</a>{self.close('p')}", f"<p><strong>{text}</strong><br>{self.prose(2, 20)}{self.close('p')}", f"<dl><dt>{_MARK}{self.prose(1, 3)}<dd>{text}</dl>"]
        kinds += [f"<{tag}>" + "".join(f"<li>{_MARK}{self.prose(1, self.pick([4, 20]))}{self.close('li')}" for _ in range(self.rng.randrange(2, 6))) + f"</{tag}>" for tag in ("ul", "ol")]
        kinds += [f"<table><tr><td>{text}{self.close('td')}<td>{_MARK}{self.prose(1, 3)}{self.close('td')}{self.close('tr')}</table>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>"]
        if link:
            kinds += [f"<p><a href=/z>{_MARK}{self.prose(10, 40)}</a>{self.close('p')}"] * 2
        return self.pick(kinds)

    def body(self, bare: bool) -> str:
        title = f"<h1>{_MARK}{self.prose(2, 9).rstrip('.')}</h1>" if self.chance(0.6) else ""
        if self.chance(0.1):  # text cut by line breaks alone
            return title + _MARK + "<br><br>".join(self.prose(15, 60) for _ in range(self.rng.randrange(1, 6)))
        parts = [title]
        for i in range(self.rng.randrange(1, 5 if self.short else 12)):
            parts.append(self.block(link=not bare) if i or not bare else f"<p>{_MARK}{self.prose(10, 24 if self.short else 60)}{self.close('p')}")
            if not bare and self.chance(0.1):
                parts.append(self.junk(self.pick(["ad", "notice", "share", "side"]), inside=True))
        return "".join(parts)

    def nest(self, inner: str, low: int, high: int) -> str:
        for _ in range(self.rng.randrange(low, high)):
            inner = self.element("div", [*_PLAIN, ""], inner)
        return inner

    def some(self, makers: list, p: float) -> str:
        self.rng.shuffle(makers)
        return "".join(make() for make in makers if self.chance(p))

    def page(self) -> str:
        head = lambda: self.pick([self.element("header", ["", *_NAMED["head"]], self.pick([f"<a href=/>{self.prose(1, 3)}</a>", f"<h2>{self.prose(1, 4)}</h2>", f"<p>{self.prose(1, 9)}</p>"])), self.element("div", _NAMED["head"], f"<h2>{self.prose(1, 5)}</h2>")])
        foot = lambda: self.pick([self.element("footer", ["", *_NAMED["foot"]], inner), self.element("div", _NAMED["foot"], inner)]) if (inner := self.pick([f"&copy; {self.prose(1, 12)}", f"<p>© 20{self.rng.randrange(10, 30)} {self.prose(1, 4)} {self.pick(_CUES['foot'])}</p>", self.listed(self.links(2, 6, "foot")), self.prose(1, 20), " | ".join(self.links(2, 5, "foot"))])) else ""
        kinds = lambda *names: [lambda k=k: self.junk(k) for k in names]
        top = self.some([self.menu, head, *kinds("ad", "notice", "share", "side"), self.form], 0.3)
        low = self.some([foot, *kinds("side", "comments", "share", "ad", "notice"), self.form, self.menu], 0.3) + (foot() if self.chance(0.6) else "")
        layout = self.pick(["semantic"] * 4 + ["named"] * 4 + ["bare"] * 3 + ["table"] * 3 + ["random"] * 2)
        if layout == "bare":
            inner = top + self.body(True) + low
        elif layout == "table":
            side = "".join(self.links(2, 8)) if self.chance(0.2) else self.pick([" ", "<br>", " | "]).join(self.links(2, 8))
            cells = [f"<td>{self.pick([side, self.listed(self.links(2, 8))])}</td>", f"<td>{self.body(True)}</td>"]
            title = f"<tr><td colspan=2>{self.pick(['<h2>{}</h2>', '<b>{}</b>', '{}']).format(self.prose(1, 5).rstrip('.'))}</td></tr>" if self.chance(0.3) else ""
            inner = top + f"<table>{title}<tr>" + "".join(cells if self.chance(0.7) else cells[::-1]) + "</tr></table>" + low
        else:
            tag, names = {"semantic": (self.pick(["article", "article", "main"]), ["", "", *_MAIN]), "named": (self.pick(["div", "div", "section", "td"]), _MAIN), "random": ("div", [*_PLAIN, ""])}[layout]
            body = self.element("div" if tag == "td" else tag, names, self.nest(self.body(layout == "random"), 0, 3) if self.chance(0.3) else self.body(layout == "random"))
            if self.chance(0.25):  # the page's other parts may sit beside the text in the main element
                body = self.element("main", ["", *_MAIN], self.some(kinds("side", "share", "notice"), 0.4) + body + self.some(kinds("side", "comments"), 0.4))
            inner = top + self.nest(body, 0, 3) + low
        inner = self.nest(inner, 0, 3)
        return f"<!DOCTYPE html><html><head><title>{self.prose(1, 8)}</title><style>p{{}}</style></head><body>{inner}" + self.pick(["</body></html>", ""])


def sample_page(rng: random.Random) -> str:
    """A page whose article blocks hold the mark U+2460 and no other block does."""
    return _Writer(rng).page()


def marked_page(html: str) -> tuple[Page, np.ndarray]:
    """(blocks without the mark, whether each had it)."""
    page = blocks_of(html)
    label = np.array([_MARK in b[1] for b in page.blocks], dtype=np.float32)
    page.blocks = [(i, t.replace(_MARK, "") or "x", a) for i, t, a in page.blocks]
    return page, label


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> BiLSTM:
    """The labeller, from generated pages; the same weights for the same arguments."""
    rng, source = np.random.default_rng(seed), random.Random(seed)
    parsed, labels = zip(*(marked_page(sample_page(source)) for _ in range(pages)), strict=True)
    x = vectors(list(parsed))
    cuts = np.cumsum([len(p.blocks) for p in parsed])[:-1]
    each = np.split(x, cuts)
    net = BiLSTM(DIM, HIDDEN)
    batches = []
    for place in np.array_split(rng.permutation(pages), max(1, pages // 48)):
        for part, xs, mask in padded([each[i] for i in place]):
            y = np.zeros(mask.shape, dtype=np.float32)
            for row, i in enumerate(part):
                y[row, : len(labels[place[i]])] = labels[place[i]]
            batches.append((xs, mask, y))
    net.fit(batches, epochs)
    return net


def extract_texts(htmls: list[str | None], net: BiLSTM) -> list[str]:
    """The main text of each page."""
    pages = [blocks_of(h) if h else Page() for h in htmls]
    x = vectors(pages)
    each = np.split(x, np.cumsum([len(p.blocks) for p in pages])[:-1]) if pages else []
    out = [""] * len(pages)
    for part, xs, mask in padded(each):
        p = net.forward(xs, mask)[0]
        for row, i in enumerate(part):
            out[i] = "\n".join(b[1] for b, good in zip(pages[i].blocks, p[row] > 0.5, strict=False) if good)
    return out


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """Append ``into``, the article's text, and ``n_chars``, its code points.

    Blocks are joined in page order by one newline; white space inside a block
    becomes one space. Null, empty or textless html gives an empty text; every
    row is kept. Columns called like an added one are replaced.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, htmls = [], batch.column(html_col)
        for a in range(0, len(htmls), 256):
            texts += extract_texts(htmls.slice(a, 256).to_pylist(), shared.value)
        return {into: pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_columns(pages, run, f"{into} string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
