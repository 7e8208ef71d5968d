"""A forgiving HTML reader: block elements with their features, and the text runs between them."""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import numpy as np

from .common import by_value

_TAG = re.compile(r"<(?:(/)?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|!--(?:.*?-->|.*+)|[!?][^>]*+>)", re.S)
_BEGIN = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(class|id|role|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SIGNS = re.compile(r"[.,;:!?]")

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template textarea title svg iframe canvas select object audio video math datalist".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label".split()
)
#: Groups of elements, in the order of their features.
GROUPS = (
    ("html", "body"), ("div",), ("section",), ("article",), ("main",), ("p",), ("h1", "h2", "h3"), ("h4", "h5", "h6"), ("ul", "ol", "dl", "menu"),
    ("li", "dt", "dd"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "button", "fieldset", "legend", "dialog"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    ("blockquote", "pre", "figure", "figcaption", "address", "details", "summary"), ("head",),
)
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g}
#: Attribute tokens with a feature each.
TOKENS = (
    "article content post entry main story body text page wrapper container title headline author date nav navigation menu navbar header masthead top "
    "footer bottom copyright legal sidebar aside widget ad ads advert advertisement banner sponsor sponsored promo cookie notice consent gdpr alert popup modal "
    "comment comments reply discussion respond share social related recommended more newsletter subscribe signup form search login breadcrumb breadcrumbs pagination pager tags meta toc"
).split()
#: Features that are numbers; groups and tokens follow, of the element itself and then of its path from the root.
NUMBERS = 17
_TOKEN_AT = {t: k for k, t in enumerate(TOKENS)}
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class _Ends:
    """Which places begin a tag that ends: asked where one was found not to, so that no place is read to the page's end twice."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.names = [m.start() for m in _NAME_END.finditer(html)]
        self.at = [m.start() for m in _QUOTE_OR_END.finditer(html)]
        self.ends = [False] * (len(self.at) + 1)  # from each quote or end on, outside of quotes: is there an end?
        after = {'"': -1, "'": -1}
        for k in range(len(self.at) - 1, -1, -1):
            c = html[self.at[k]]
            if c == ">":
                self.ends[k] = True
            else:
                self.ends[k] = after[c] >= 0 and self.ends[after[c] + 1]
                after[c] = k

    def tag(self, at: int) -> bool:
        if self.html.startswith("<!--", at):
            return True
        if self.html.startswith(("<!", "<?"), at):
            return at < self.last
        if not _BEGIN.match(self.html, at):
            return False
        k = bisect_left(self.names, at + (2 if self.html[at + 1] == "/" else 1))
        return k < len(self.names) and self.ends[bisect_left(self.at, self.names[k])]


class Page:
    """Block elements in page order (parents first) and runs of text, each with its element.

    Reading takes time in proportion to the page, however its tags nest or fail to close.
    Training pages say in data-y what is main text; nothing else reads that.
    """

    __slots__ = ("depth", "group", "parent", "runs", "tokens", "truth")

    def __init__(self, html: str):
        self.group, self.parent, self.tokens, self.truth, self.depth = [-1], [-1], [()], [1], [0]
        self.runs: list[tuple[int, str, int]] = []  # element, text, characters within links
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, list[int]] = {}  # where in the stack the elements of a name are
        blocks = [0]  # where in the stack the block elements are
        pieces: list[str] = []
        linked, at, scan = 0, 0, 0
        ends: _Ends | None = None

        def flush() -> None:
            nonlocal linked
            if pieces:
                if text := " ".join(unescape("".join(pieces)).split()):
                    self.runs.append((stack[blocks[-1]][1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def last(names) -> int:
            return max((opened[n][-1] for n in names if opened.get(n)), default=-1)

        def push(name: str, block: int) -> None:
            opened.setdefault(name, []).append(len(stack))
            stack.append((name, block))

        def close(depth: int) -> None:
            if blocks[-1] >= depth:
                flush()
            while len(stack) > depth:
                name, n = stack.pop()
                opened[name].pop()
                if n >= 0:
                    blocks.pop()

        while True:
            here = html.find("<", scan)
            m = None
            if here >= 0:
                if ends is None or ends.tag(here):
                    m = _TAG.match(html, here)
                if not m:  # no tag: text like any other
                    if ends is None and _BEGIN.match(html, here) or html.startswith(("<!", "<?"), here):
                        ends = ends or _Ends(html)
                    scan = here + 1
                    continue
            if text := html[at : here if here >= 0 else len(html)]:
                pieces.append(text)
                if opened.get("a"):
                    linked += len(text)
            if not m:
                break
            at = scan = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                pieces.append("\n")
            elif m[1]:
                depth = last((name,))
                if depth > (blocks[-1] if name in _INLINE else 0):
                    close(depth)
            elif name in SILENT:
                if not m[3].endswith("/"):
                    stop = _find_end(html, name, at)
                    at = scan = len(html) if stop < 0 else stop
            elif name in _EMPTY:
                if name == "hr":
                    flush()
            elif name in _INLINE:
                if not m[3].endswith("/"):
                    push(name, -1)
            else:
                flush()
                # an opening block element ends an open paragraph, and its like in lists and tables
                if stack[blocks[-1]][0] == "p":
                    close(blocks[-1])
                if name in _CLOSED_BY:
                    ended, within = _CLOSED_BY[name]
                    while (depth := last(ended)) > last(within):
                        close(depth)
                        if name != "tr":
                            break
                self._add(name, stack[blocks[-1]][1], m[3])
                blocks.append(len(stack))
                push(name, len(self.group) - 1)
        flush()

    def _add(self, name: str, parent: int, attributes: str) -> None:
        self.group.append(_GROUP.get(name, -1))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        got, truth = [], self.truth[parent]
        for a, x, y, z in _NAMED.findall(attributes) if attributes else ():
            if a.lower() == "data-y":
                truth = int(x) if x in ("0", "1") else truth
            else:
                got += [_TOKEN_AT[t] for t in _TOKEN.findall(_CAMEL.sub(" ", x or y or z).lower()) if t in _TOKEN_AT]
        self.tokens.append(tuple(got))
        self.truth.append(truth)


def _find_end(html: str, name: str, at: int) -> int:
    """Where the closing tag of a silent element starts, in either case; -1 if nowhere."""
    while (at := html.find("</", at)) >= 0:
        if html[at + 2 : at + 2 + len(name)].lower() == name:
            return at
        at += 2
    return -1


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row an element of all pages: features; and each element's parent row and page."""
    sizes = np.array([len(p.group) for p in pages])
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    page = np.repeat(np.arange(len(pages)), sizes)
    group = np.concatenate([p.group for p in pages])
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=True)])
    parent[first] = first
    run_of = np.array([f + r[0] for p, f in zip(pages, first, strict=True) for r in p.runs], np.int64)
    run_len = np.array([len(r[1]) for p in pages for r in p.runs], np.float64)
    run_link = np.array([r[2] for p in pages for r in p.runs], np.float64)
    run_sign = np.array([len(_SIGNS.findall(r[1])) for p in pages for r in p.runs], np.float64)
    own = np.bincount(run_of, run_len, n)
    sums = np.stack([own, np.bincount(run_of, run_link, n), np.bincount(run_of, run_sign, n), np.ones(n), np.where(group == 5, own, 0), np.bincount(run_of, minlength=n).astype(float)], 1)
    depth = np.concatenate([p.depth for p in pages])
    order = np.argsort(depth, kind="stable")
    level = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if n else np.zeros(1, int)
    tokens = np.zeros((n, len(TOKENS)), bool)
    rows = [(f + i, t) for p, f in zip(pages, first, strict=True) for i, ts in enumerate(p.tokens) for t in ts]
    if rows:
        r, t = np.array(rows).T
        tokens[r, t] = True
    groups = np.zeros((n, len(GROUPS)), bool)
    has = np.flatnonzero(group >= 0)
    groups[has, group[has]] = True
    above_tokens, above_groups = tokens.copy(), groups.copy()
    for k in range(1, len(level) - 1):
        here = order[level[k] : level[k + 1]]
        above_tokens[here] |= above_tokens[parent[here]]
        above_groups[here] |= above_groups[parent[here]]
    for k in range(len(level) - 2, 0, -1):
        here = order[level[k] : level[k + 1]]
        np.add.at(sums, parent[here], sums[here])
    total = sums[first][page]
    text, link, sign, nodes, paragraphs, runs = sums.T
    # siblings in page order
    by = np.lexsort((np.arange(n), parent))
    by = by[~np.isin(by, first)]
    new = np.ones(len(by), bool)
    new[1:] = parent[by[1:]] != parent[by[:-1]]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(by)))
    place, siblings = np.zeros(n), np.ones(n)
    place[by] = np.arange(len(by)) - np.repeat(start, count)
    siblings[by] = np.repeat(count, count)
    before_text, after_text = np.zeros(n), np.zeros(n)
    inner = np.flatnonzero(~new)
    before_text[by[inner]] = text[by[inner - 1]]
    after_text[by[inner - 1]] = text[by[inner]]
    # text of the page that stands before an element: of all elements that begin before it and their runs before it
    ahead = np.cumsum(own) - own
    ahead -= ahead[first][page]
    one = np.maximum(total[:, 0], 1)
    numeric = np.stack([
        np.log1p(own), np.log1p(text), link / np.maximum(text, 1), text / one, np.log1p(nodes), np.log1p(text / nodes), depth, place / siblings, np.log1p(siblings), ahead / one,
        np.maximum(total[:, 0] - ahead - text, 0) / one, sign / np.maximum(text, 1), paragraphs / np.maximum(text, 1), link[parent] / np.maximum(text[parent], 1), np.log1p(before_text), np.log1p(after_text), np.log1p(runs),
    ], 1)
    return np.concatenate((numeric, groups, tokens, above_groups, above_tokens), 1).astype(np.float32), parent, page


by_value(__name__)
