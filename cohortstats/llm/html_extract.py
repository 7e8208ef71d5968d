"""Main text of web pages: boosted trees over DOM elements, decoded from the root down.

Gradient-boosted trees give each block element the odds of holding main text, from its
subtree's densities, attribute tokens, depth, siblings and ancestors. Decoding maximises
the summed log odds over the tree under one rule: below an element that is left out all
is left out, so an element never contradicts its ancestors. The trees are trained on
pages that ``training_page`` makes up with their truth, a fixed number from a fixed seed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, groups, mapped, table
from .dom import GROUPS, NUMBERS, TOKENS, Page, features

#: The training set and the trees.
TRAINING_PAGES, SEED, TREES, DEPTH, RATE, BINS, RIDGE = 600, 11, 30, 4, 0.3, 32, 1.0
GROUP_BYTES = 2 << 20

_MODEL: list = []


class Trees:
    """Boosted trees of fixed depth for a two-class log loss, grown on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, entered: np.ndarray) -> Trees:
        """``entered``: the rows whose parent is main text, where an element's own name and tokens decide."""
        marks = x[entered][:, NUMBERS : NUMBERS + len(GROUPS) + len(TOKENS)]
        pro, con = (marks * y[entered][:, None]).sum(0), (marks * (1 - y[entered])[:, None]).sum(0)
        self.worth = np.log((pro + 1) / (con + 1)).astype(np.float32)
        x = self._with_worth(x)
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS)[1:-1])) if len(np.unique(c)) > 2 else np.array([0.5]) for c in x.T]
        bins = self._bin(x)
        n, width = bins.shape
        two = np.array([len(c) == 1 for c in self.cuts])  # features of two values: one product gives their sums
        many = np.flatnonzero(~two)
        flat = bins[:, many].astype(np.int64) + np.arange(len(many)) * BINS
        zero = np.ascontiguousarray((bins[:, two] == 0).astype(np.float32))
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []

        def sums(node: np.ndarray, k: int, of: np.ndarray) -> np.ndarray:
            """Of each node, feature and cut: the sum over rows at or below the cut."""
            out = np.zeros((k, width, BINS))
            at = (node * (len(many) * BINS))[:, None] + flat
            out[:, many] = np.bincount(at.ravel(), np.repeat(of, len(many)), k * len(many) * BINS).reshape(k, len(many), BINS).cumsum(2)
            each = np.zeros((k, n), np.float32)
            each[node, np.arange(n)] = of
            out[:, two] = each.sum(1, dtype=np.float64)[:, None, None]
            out[:, two, 0] = each @ zero
            return out

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for level in range(DEPTH):
                k = 2**level
                gs, hs = sums(node, k, g), sums(node, k, h)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (np.maximum(ht - hs, 0) + RIDGE) - gt**2 / (ht + RIDGE)
                best = gain.reshape(k, -1).argmax(1)
                feature[k - 1 : 2 * k - 1], cut[k - 1 : 2 * k - 1] = best // BINS, best % BINS
                node = 2 * node + (bins[np.arange(n), feature[k - 1 + node]] > cut[k - 1 + node])
            leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + RIDGE)
            score += leaf[node]
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(leaf)
        return self

    @classmethod
    def of(cls, parts: dict) -> Trees:
        """The trees of these attributes: plain arrays are what is sent, so executors need no copy of the package."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def _with_worth(self, x: np.ndarray) -> np.ndarray:
        """The features and two more: the least worth of the element's own marks, and of those on its path from the root."""
        own = x[:, NUMBERS : NUMBERS + len(self.worth)] > 0
        path = x[:, NUMBERS + len(self.worth) :] > 0
        least = [np.where(m, self.worth, 9).min(1, initial=9) for m in (own, path)]
        return np.concatenate((x, np.stack(least, 1)), 1)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)], 1).astype(np.uint8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        bins = np.ascontiguousarray(self._bin(self._with_worth(x)))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                k = 2**level - 1 + node
                node = 2 * node + (bins[rows, feature[k]] > cut[k])
            out += leaf[node]
        return out


def keep(odds: np.ndarray, parent: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which elements stay: the choice of the largest sum of log odds in which what is below a left-out element is left out.

    Parents stand before their children, and a page's first element is its own parent.
    """
    gain = odds.copy()  # of an element that stays, with the best choice below it
    root = parent == np.arange(len(parent))
    for k in range(len(odds) - 1, -1, -1):
        if not root[k] and gain[k] > 0:
            gain[parent[k]] += gain[k]
    out = gain > 0
    out[root] = True
    for k in np.flatnonzero(~root):
        out[k] &= out[parent[k]]
    return out


_SYLLABLES = "the an or in to re st ing ou ti en er on le de que au ch ung ei ver la el os as ie ción é ü ra".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))


def _sentence(r: random.Random, low: int = 4, high: int = 22) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high))).capitalize() + r.choice(".....!?;")


def _prose(r: random.Random, low: int = 1, high: int = 7) -> str:
    return " ".join(_sentence(r) for _ in range(r.randint(low, high)))


def _links(r: random.Random, n: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{_word(r)}">{" ".join(_word(r) for _ in range(r.randint(1, 4)))}</a></{tag}>' for _ in range(n))


def _row_of_links(r: random.Random) -> str:
    between = r.choice((" ", " | ", "<br>", " - "))
    return r.choice(("", f"{_word(r).capitalize()}: ")) + between.join(f'<a href="{_word(r)}.html">{_word(r)}</a>' for _ in range(r.randint(2, 8)))


def _clutter(r: random.Random, kind: str) -> str:
    """An element that is not main text, of a kind."""

    prose = _prose(r, 1, 3)
    if kind in ("nav", "share") and r.random() < 0.25:  # links alone, with no name that tells
        tag, named = r.choice(("div", "div", "p", "ul")), r.choice(("", f' class="{_word(r)}"'))
        return f'<{tag} data-y="0"{named}>{_row_of_links(r)}</{tag}>'

    def box(tags: str, names: str, inner: str) -> str:
        tag = r.choice(tags.split())
        name = r.choice(names.split()) if tag in ("div", "section", "ul", "ol", "p") or r.random() < 0.4 else ""
        if tag == "p":  # it would end before a block within
            inner = prose
        attribute = f' {r.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f'<{tag} data-y="0"{attribute}>{inner}</{tag}>'

    if kind == "nav":
        return box("nav nav div ul", "nav menu navigation main-menu navbar breadcrumb breadcrumbs toc pagination", r.choice(("<ul>%s</ul>", "%s")) % _links(r, r.randint(3, 12)))
    if kind == "header":
        return box("header header div", "header masthead top site-header page-header", r.choice((f"<h1>{_sentence(r, 1, 4)}</h1>", f"<div>{_sentence(r, 2, 6)}</div>", f"<p>{prose}</p>")) + _clutter(r, "nav") * (r.random() < 0.5))
    if kind == "footer":
        return box("footer footer div", "footer site-footer copyright bottom legal", r.choice((f"&copy; {_word(r)}.example.com", f"&copy; {_word(r)} &middot; {prose}", f"<p>{prose}</p>", f"<ul>{_links(r, 4)}</ul><p>{prose}</p>")))
    if kind == "aside":
        return box("aside aside div section", "sidebar aside widget related recommended more-stories", f"<h3>{_sentence(r, 1, 4)}</h3>" * (r.random() < 0.6) + r.choice((f"<p>{prose}</p>", f"<ul>{_links(r, 6)}</ul>", f"<div>{prose}</div>")))
    if kind == "ad":
        return box("div div div section p", "ad ads advert advertisement banner sponsor sponsored promo ad-banner", r.choice((prose, f"<p>{prose}</p>", f'<a href="#">{prose}</a>', f"<div><span>{prose}</span></div>")))
    if kind == "notice":
        return box("div div section p", "cookie notice cookie-notice consent gdpr alert popup modal cookie-banner", r.choice((prose, f"<p>{prose}</p><button>{_word(r)}</button>", f"<p>{prose}</p>")))
    if kind == "form":
        return box("form form div", "form newsletter subscribe signup search login newsletter-signup", f"<p>{prose}</p>" * (r.random() < 0.7) + f'<label>{_word(r)}</label><input name="q"><button>{_word(r)}</button>')
    if kind == "share":
        return box("div ul", "share social share-buttons social-links tags meta", _links(r, r.randint(2, 6)))
    said = "".join(r.choice((f'<li class="comment"><p>{_prose(r, 1, 3)}</p></li>', f'<div class="comment"><b>{_word(r)}</b><p>{_prose(r, 1, 3)}</p></div>', f"<p>{_prose(r, 1, 3)}</p>", f"<article><p>{_prose(r, 1, 2)}</p></article>")) for _ in range(r.randint(1, 6)))
    return box("section div ol", "comments comment-list discussion respond reply comments-area", f"<h2>{_sentence(r, 1, 3)}</h2>" * (r.random() < 0.5) + said)


KINDS = ("nav", "header", "footer", "aside", "ad", "notice", "form", "share", "comments")


def training_page(r: random.Random) -> str:
    """A made-up page whose elements carry their truth: data-y 0 begins what is not main text."""
    blocks = [f"<h1>{_sentence(r, 2, 10)}</h1>"] * (r.random() < 0.8)
    if r.random() < 0.15:
        blocks = [f"<header>{''.join(blocks) or '<p>' + _sentence(r) + '</p>'}</header>"]
    for _ in range(r.choice((0, 1, 1, 1, 2, 2, 3, 4, 6, 9, 14, 25, 60))):
        kind = r.random()
        if kind < 0.7:
            p = r.choice((_prose(r), _prose(r), _prose(r, 1, 2), _sentence(r, 1, 3)))
            if r.random() < 0.2:
                p = f"<b>{_sentence(r, 1, 5)}</b> {p}"
            if r.random() < 0.15:
                p = f'{p} <a href="/x">{_sentence(r, 1, 5)}</a> {_sentence(r)}'
            # as in the wild, some paragraphs and inline elements are never closed
            blocks.append(f"<p>{p}</p>" if r.random() < 0.85 else f"<p><b>{p}<br>")
        elif kind < 0.78:
            tag = f"h{r.randint(2, 4)}"
            blocks.append(f"<{tag}>{_sentence(r, 1, 8)}</{tag}>")
        elif kind < 0.84:
            blocks.append("<ul>" + "".join(f"<li>{_sentence(r, 2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.88:
            blocks.append(f"<blockquote><p>{_prose(r, 1, 3)}</p></blockquote>")
        elif kind < 0.91:
            blocks.append("<table>" + "".join(f"<tr><td>{_sentence(r, 1, 6)}</td><td>{_sentence(r, 1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif kind < 0.94:
            blocks.append(f'<figure><img src="x.png"><figcaption>{_sentence(r, 3, 12)}</figcaption></figure>')
        elif kind < 0.97:
            blocks.append(f"<pre>{_prose(r, 1, 3)}</pre>")
        else:
            blocks.append(f"<div><p>{_prose(r)}</p></div>")
    for kind in ("ad", "share", "aside", "form", "notice", "nav"):
        if r.random() < 0.12:
            blocks.insert(r.randint(0, len(blocks)), _clutter(r, kind))
    if r.random() < 0.12:
        blocks.append(_clutter(r, "comments"))
    tag, name = r.choice((("article", ""), ("article", ""), ("main", ""), ("article", "post"), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "article-body"), ("div", "main-content"), ("div", "text"), ("div", ""), ("", "")))
    main = "".join(blocks)
    if tag:
        main = f'<{tag}{f""" class="{name}" """ if name else ""}>{main}</{tag}>'
    if r.random() < 0.3:
        main = f'<div class="{r.choice(("wrapper", "container", "page", "main", "row"))}">{main}</div>'
    if r.random() < 0.1:  # laid out as a table
        ends = f'<tr><td data-y="0" colspan="2">{r.choice(("&copy;", "Copyright"))} {r.randint(1996, 2025)} {_sentence(r, 1, 6)}</td></tr>' if r.random() < 0.7 else ""
        main = f'<table width="100%"><tr><td data-y="0">{_row_of_links(r)}</td><td>{main}</td></tr>{ends}</table>'
    ahead = [_clutter(r, k) for k in ("notice", "header", "nav", "ad", "form", "aside") if r.random() < (0.7 if k == "nav" else 0.35)]
    after = [_clutter(r, k) for k in ("share", "comments", "aside", "ad", "form", "nav", "footer", "notice") if r.random() < (0.75 if k == "footer" else 0.25)]
    r.shuffle(ahead)
    middle = main + "".join(after[:-1]) if r.random() < 0.3 else main
    body = "".join(ahead) + middle + "".join(after if middle is main else after[-1:])
    return f"<!DOCTYPE html><html><head><title>{_word(r)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Trees:
    """The trees; made once a process, the same from everywhere."""
    if not _MODEL:
        r = random.Random(seed)
        made = [Page(training_page(r)) for _ in range(pages)]
        x, parent, page = features(made)
        y = np.concatenate([p.truth for p in made]).astype(float)
        # of many elements of one kind, truth and parent a few stand for all, so that long pages don't outweigh the rest
        alike = np.stack((parent, np.concatenate([p.group for p in made]), y.astype(int)), 1)
        _, kind, count = np.unique(alike, axis=0, return_inverse=True, return_counts=True)
        some = np.flatnonzero(np.random.RandomState(seed).rand(len(y)) < 4 / count[kind.ravel()])
        _MODEL.append(Trees().fit(x[some], y[some], np.minimum(1, 2 / np.sqrt(count[kind.ravel()][some])), (y[parent] == 1)[some]))
    return _MODEL[0]


def main_text(htmls: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    x, parent, page = features(pages)
    kept = keep(trees.odds(x), parent, page)
    first = np.searchsorted(page, np.arange(len(pages)))
    return ["\n".join(text for element, text, _ in p.runs if kept[f + element]) for p, f in zip(pages, first.tolist(), strict=True)]


def _extract(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees.of(send.value)
        for part in groups(batches, 2, GROUP_BYTES):
            text = main_text(part.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page row.

    Null or empty html, and a page without main text, give an empty text. Ids and urls may be null
    and rows may repeat; each row gets its row. An empty table gives an empty result. Other columns
    are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    send = pages.sparkSession.sparkContext.broadcast(vars(train()))
    return rows.transform(mapped, _extract(send), "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_extract": op3_html_extract}
ORACLE_SQL: dict[str, str] = {}

by_value(__name__)
