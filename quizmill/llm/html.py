"""HTML extraction: boosted trees over DOM-node features, decoded from the root down."""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.common import slices, with_columns

#: Most pages that the trees are grown on (each eight times: without and with side matter set into it, under four sets of
#: names), trees, depth, bins and step.
SAMPLE, TREES, DEPTH, BINS, RATE = 300, 60, 4, 16, 0.3
SEED = 5

#: Element kinds, and class, id and role words that name main or side matter.
BLOCKS = set("html body main article section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table thead tbody tfoot tr address details summary dialog menu center hr".split())
SILENT = set("script style title noscript template iframe svg object canvas select option button textarea audio video head".split())
#: Silent elements that pages forget to end: without an end of their own they reach to the next block.
CONTROLS = set("button select option canvas object audio video".split())
RAW = {"script", "style", "title", "textarea", "iframe", "noscript", "template"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
MAIN_TAGS = {"article", "main"}
SIDE_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promotion related reply replies responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
MAIN_WORDS = set("article articlebody body-text content entry main maincontent post story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CONTROL = re.compile(r"<(/?)(button|select|option|canvas|object|audio|video)\b", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    up: int
    depth: int
    words: frozenset = frozenset()
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """Block elements and runs of text between them (tag ""), parents before children. Paragraphs and list items end where
    the next begins; an end tag without a start is passed over; what a silent element holds is left out. A run's text has
    its references decoded and its white space made single blanks."""
    nodes = [Node("html", -1, 0)]
    stack, piece, link, in_link, hush = [0], [], 0, False, []
    at, raw, loose = 0, "", False
    marks: dict[str, tuple[list[int], list[int]]] = {}
    for m in _CONTROL.finditer(page):
        marks.setdefault(m.group(2).lower(), ([], []))[bool(m.group(1))].append(m.start())

    def unended(tag: str, place: int) -> bool:
        """Whether the control that starts here is not ended before another of its kind starts."""
        opens, closes = marks[tag]
        i, j = bisect_right(opens, place), bisect_right(closes, place)
        return j == len(closes) or (i < len(opens) and opens[i] < closes[j])

    def close() -> None:
        nonlocal link
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                up = stack[-1]
                nodes[up].children.append(len(nodes))
                nodes.append(Node("", up, nodes[up].depth + 1, text=text, linked=min(link, len(text))))
            piece.clear()
        link = 0

    def say(text: str) -> None:
        nonlocal link
        if text and not hush:
            text = entities.unescape(text) if "&" in text else text
            piece.append(text)
            if in_link:
                link += len(text)

    def end(tag: str, fence: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = nodes[stack[k]].tag
            if name == tag:
                close()
                del stack[k:]
                return
            if name in fence:
                return

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if raw:
            if closing and tag == raw:
                raw = ""
                hush.pop()
                at = m.end()
            continue
        say(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if hush and loose and tag in BLOCKS:
            hush.clear()
            loose = False
        if hush:
            if tag in SILENT:
                if not closing:
                    hush.append(tag)
                    raw = tag if tag in RAW else ""
                elif tag in hush:
                    del hush[hush.index(tag) :]
            elif tag == "body" and hush == ["head"]:
                hush.clear()
            if hush or tag != "body":
                continue
        if tag in SILENT:
            if not closing and not m.group(0).endswith("/>"):
                hush.append(tag)
                raw = tag if tag in RAW else ""
                loose = tag in CONTROLS and unended(tag, m.start())
        elif tag == "a":
            in_link = not closing
        elif tag in ("br", "td", "th", "wbr"):
            piece.append(" ")
        elif tag == "html":
            pass
        elif tag in BLOCKS:
            if closing:
                close()
                end(tag, set())
                continue
            end("p", {"div", "article", "section", "li", "td", "aside", "blockquote", "form"} - {tag})
            if tag in ("li", "dt", "dd", "tr"):
                end(tag, {"ul", "ol", "dl", "table", "menu"})
            close()
            if tag == "hr":
                continue
            up = stack[-1]
            words = frozenset(w for v in _NAMES.findall(m.group(3)) for w in v.strip("\"'").lower().split()) if m.group(3) else frozenset()
            nodes[up].children.append(len(nodes))
            nodes.append(Node(tag, up, nodes[up].depth + 1, words))
            stack.append(len(nodes) - 1)
    if not raw:
        say(page[at:])
    close()
    return nodes


def _side(x: Node, in_main: bool) -> bool:
    return x.tag in SIDE_TAGS or (x.tag == "header" and not in_main) or not SIDE_WORDS.isdisjoint(x.words)


def _main(x: Node) -> bool:
    return x.tag in MAIN_TAGS or not MAIN_WORDS.isdisjoint(x.words)


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node, in the order of NAMES: kind of element, attribute tokens, names above, depth, siblings, and subtree
    densities."""
    n = len(nodes)
    chars, linked, runs, stops, order, links = ([0] * n for _ in range(6))
    near, main = [-1] * n, [0] * n
    so_far = 0
    for i, x in enumerate(nodes):
        order[i] = so_far
        above = main[x.up] if i else 0
        near[i] = i if _side(x, bool(above)) else (near[x.up] if i else -1)
        main[i] = _main(x) + above
        if not x.tag:
            chars[i], linked[i], runs[i] = len(x.text), x.linked, 1
            stops[i] = x.text.count(".") + x.text.count(",") + x.text.count("!") + x.text.count("?")
            links[i] = x.linked > 0
            so_far += len(x.text)
    for i in range(n - 1, 0, -1):
        up = nodes[i].up
        for sums in (chars, linked, runs, stops, links):
            sums[up] += sums[i]
    total, named = max(1, chars[0]), any(main)
    kinds = [Counter(nodes[j].tag for j in x.children) for x in nodes]
    out = np.zeros((n, len(NAMES)), np.float32)
    for i, x in enumerate(nodes):
        up = nodes[x.up] if i else x
        tag = x.tag or up.tag
        size, kin, above = max(1, chars[i]), len(up.children) if i else 1, max(1, chars[x.up] if i else chars[0])
        out[i] = (
            not x.tag, tag == "p", tag in HEADINGS, tag in ("li", "ul", "ol"), tag in ("div", "section"), tag in ("table", "tr"), tag in ("html", "body"),
            len(x.words), chars[near[i]] / total if near[i] >= 0 else 2, main[i], named, x.depth, kin, kinds[x.up][x.tag] / max(1, kin) if i else 1, len(x.children),
            math.log1p(chars[i]), linked[i] / size, chars[i] / total, math.log1p(chars[i] / max(1, runs[i])), 20 * stops[i] / size, order[i] / total, math.log1p(total),
            linked[x.up if i else 0] / above, 20 * stops[x.up if i else 0] / above, math.log1p(chars[x.up if i else 0]), links[i] / max(1, runs[i]), runs[i], (total - order[i] - chars[i]) / total,
        )
    return out


#: What each feature tells; those of text in a subtree are densities.
NAMES = (
    "run paragraph heading list division table page tokens side_share main_above main_named depth siblings alike children "
    "chars links share run_chars stops before page_chars up_links up_stops up_chars linked_runs runs after"
).split()
DENSITIES = {"chars", "links", "share", "run_chars", "stops", "up_links", "up_stops", "up_chars", "linked_runs"}


def rule_labels(nodes: list[Node]) -> np.ndarray:
    """True labels of pages that name their parts: a run is main text if nothing around it is named side matter and, where a
    page has an element named as main, it stands in one; an element is main if it holds such a run. The trees see most of these pages under
    other names (see disguised), so they can't restate this."""
    n = len(nodes)
    side, main = [False] * n, [False] * n
    for i, x in enumerate(nodes):
        above = bool(i and main[x.up])
        main[i] = above or _main(x)
        side[i] = bool(i and side[x.up]) or _side(x, above)
    named = any(main)
    label = np.array([not x.tag and not side[i] and (main[i] or not named) for i, x in enumerate(nodes)])
    for i in range(n - 1, 0, -1):
        label[nodes[i].up] |= label[i]
    return label


def wrapped(nodes: list[Node], at: int, tag: str, words: frozenset) -> list[Node]:
    """The page with one more element around all that the node at `at` holds; it stands right behind that node."""
    out = []
    for i, x in enumerate(nodes):
        inner = i > at  # nodes behind it may be others' children: only its own get deeper
        up = x.up if x.up < at or not inner else (at + 1 if x.up == at else x.up + 1)
        deeper = inner and (x.up == at or (x.up > at and out[x.up + 1].depth > nodes[x.up].depth))
        out.append(replace(x, up=up, depth=x.depth + deeper, children=[c + (c > at) for c in x.children]))
        if i == at:
            out.append(Node(tag, at, x.depth + 1, words, children=[c + 1 for c in x.children]))
            out[at].children = [at + 1]
    return out


def disguised(nodes: list[Node], label: np.ndarray, kind: int, rng: np.random.Generator) -> tuple[list[Node], np.ndarray]:
    """The same page under other names, and its labels: 0 as it is; 1 without any names, semantic elements as plain
    divisions; 2 without the names of main matter; 3 with a side name around all of it. But for 0, up to two plain divisions
    stand around its parts as well."""
    out = [replace(x) for x in nodes]
    if kind in (1, 2):
        for x in out:
            if _main(x) or (kind == 1 and (x.tag in SIDE_TAGS or x.tag == "header")):
                x.tag = "div"
            x.words = frozenset() if kind == 1 else x.words - MAIN_WORDS
    whole = next((i for i, x in enumerate(out) if x.tag == "body"), 0)
    around = [("div", frozenset())] * int(rng.integers(3)) if kind else []
    if kind == 3:
        name = sorted(SIDE_WORDS)[rng.integers(len(SIDE_WORDS))]
        around.insert(int(rng.integers(len(around) + 1)), ("form", frozenset()) if rng.integers(2) else ("div", frozenset({name})))
    for tag, words in around:
        out, label = wrapped(out, whole, tag, words), np.insert(label, whole, label[whole])
    return out, label


def with_side_matter(page: str, other: str, rng: np.random.Generator) -> str:
    """The page with blocks of another page set around and into it under names of side matter, and its main element under
    another name now and then: what the given pages lack, the trees learn from these."""
    texts = [x.text for x in parse(other) if not x.tag and len(x.text) > 20] or ["other matter"]
    names = sorted(SIDE_WORDS)

    def box() -> str:
        inner = "".join(f"<p>{entities.escape(texts[rng.integers(len(texts))])}</p>" for _ in range(rng.integers(1, 4)))
        tag = ["aside", "form", "div", "div", "section", "header", "ul"][rng.integers(7)]
        return f'<{tag} class="{names[rng.integers(len(names))]}">{inner}</{tag}>' if tag in ("div", "section", "ul") else f"<{tag}>{inner}</{tag}>"

    page = re.sub(r"(<body[^>]*>)", lambda m: m.group(1) + box(), page, count=1)
    page = page.replace("</article>", box() + "</article>" + box(), 1)
    paragraphs = [m.end() for m in re.finditer("</p>", page)]
    if paragraphs:
        k = paragraphs[rng.integers(len(paragraphs))]
        page = page[:k] + box() + page[k:]
    kind = rng.integers(4)
    if kind < 2:
        opening, closing = (("<main>", "</main>"), ('<div class="content">', "</div>"))[kind]
        page = page.replace("<article>", opening, 1).replace("</article>", closing, 1)
    return page


@dataclass
class Forest:
    """Boosted regression trees of DEPTH levels on the log loss: feature and threshold of each split, value of each leaf."""

    bias: float
    feature: np.ndarray  # trees x (2 ** DEPTH - 1)
    limit: np.ndarray
    leaf: np.ndarray  # trees x 2 ** DEPTH

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias, np.float64), np.arange(len(x))
        for f, t, v in zip(self.feature, self.limit, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting with Newton leaves; splits are tried at up to BINS quantiles of each feature."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # v > cuts[k - 1]
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score, inner = np.full(len(y), bias), 2**DEPTH - 1
    features_, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p) + 1e-6
        at, f, t = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-9
            if len(rows) >= 8:
                gs, hs = g[rows].sum(), h[rows].sum()
                base = gs * gs / (hs + 1)
                for k, c in enumerate(cuts):
                    gl = np.cumsum(np.bincount(codes[k, rows], weights=g[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(codes[k, rows], weights=h[rows], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - base
                    j = gain.argmax()
                    if gain[j] > best:
                        best, f[node], t[node] = gain[j], k, c[j]
            at[rows] = 2 * node + 1 + (x[rows, f[node]] > t[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + 1)
        score += value[leaf]
        features_.append(f), limits.append(t), leaves.append(value)
    return Forest(bias, np.array(features_), np.array(limits), np.array(leaves))


def chosen(nodes: list[Node], logit: np.ndarray) -> list[str]:
    """Texts of the runs kept by the best consistent choice: a node can only be kept with all above it, so a subtree is
    worth its node's log odds and what its children are worth, or nothing and goes whole."""
    worth = logit.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[nodes[i].up] += worth[i]
    kept = [False] * len(nodes)
    out = []
    for i, x in enumerate(nodes):
        kept[i] = bool(worth[i] > 0 and (i == 0 or kept[x.up]))
        if kept[i] and not x.tag:
            out.append(x.text)
    return out


def fit(pages: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Grow the trees, in one task, on about `sample` pages chosen by a hash of their html, and on copies of them with side
    matter. Null and empty pages are no use; None if there are no others."""
    rows = pages.filter("html <> ''").select("html")
    n = rows.count()
    if not n:
        return None
    order = F.pmod(F.xxhash64("html", F.lit(SEED)), F.lit(1 << 30))
    few = rows.withColumn("order", order).filter(F.col("order") * n < F.lit(max(sample, 1) << 30)).withColumn("task", F.lit(0))
    few = few if few.take(1) else rows.orderBy(order).limit(1).withColumn("order", order).withColumn("task", F.lit(0))

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("html").sort_values("order", ignore_index=True)
        rng, some = np.random.default_rng(SEED), list(part["html"])
        some += [with_side_matter(p, some[k - 1], rng) for k, p in enumerate(some)]
        told = [(x, rule_labels(x)) for x in map(parse, some)]
        seen = [disguised(x, y, kind, rng) for x, y in told for kind in range(4)]
        f = grow(np.vstack([features(x) for x, _ in seen]), np.concatenate([y for _, y in seen]).astype(float))
        return pd.DataFrame({"name": ["bias", "feature", "limit", "leaf"], "value": [np.asarray(v, float).tobytes() for v in (f.bias, f.feature, f.limit, f.leaf)]})

    got = {r.name: np.frombuffer(r.value) for r in few.groupBy("task").applyInPandas(train, "name string, value binary").collect()}
    return Forest(float(got["bias"][0]), got["feature"].astype(int).reshape(TREES, -1), got["limit"].reshape(TREES, -1), got["leaf"].reshape(TREES, -1))


def extract(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """pages with `text`, the main text of each whole html: kept runs in page order, one to a line. Null and empty pages,
    and pages of which nothing is kept, have an empty text. A column named text is replaced; every row stays."""

    names = [c for c in pages.columns if c != "text"]

    def main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html"):
                parsed = [parse(p or "") for p in b.column("html").to_pylist()]
                logit = forest.logit(np.vstack([features(x) for x in parsed])) if forest else np.zeros(sum(map(len, parsed)))
                ends = np.cumsum([len(x) for x in parsed])
                texts = ["\n".join(chosen(x, logit[e - len(x) : e])) for x, e in zip(parsed, ends, strict=True)]
                yield with_columns(b, names, {"text": pa.array(texts, pa.string())})

    out = T.StructType([*pages.select(*names).schema.fields, T.StructField("text", T.StringType())])
    return pages.select(*names).mapInArrow(main_text, out)
