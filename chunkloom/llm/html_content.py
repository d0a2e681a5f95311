"""Operator 6: content extraction by a tree-structured graphical model over DOM nodes.

Every element is a node with two states, content and boilerplate. A node's own potential is a sum of weights
of its features (tag, class and id, amount of text, link density, punctuation, depth, place); a potential on
each parent-child edge, by the child's tag, says how the states agree. Being a tree, sum-product messages
sent once up and once down give exact marginals; text of nodes whose content marginal is at least a half is
the page's content. The weights maximise the conditional likelihood of labelled pages; its gradient is the
difference of observed and expected features, the latter from the same messages.

Labelled pages: a bounded sample (SAMPLE) of the pages whose title begins a document of the ``documents`` table;
an element's own text is content where such a document has it. Messages run for all the pages of an Arrow
slice together, one vectorised step for each depth of the trees, in time proportional to the nodes.
"""

from __future__ import annotations

import html
import logging
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.llm._frames import slices
from chunkloom.llm._grams import bounded_sample
from chunkloom.plans.lineage import cut

SAMPLE = 800  #: labelled pages at most that the model is fitted on
TEXTS = 8  #: distinct documents at most that a sampled page is labelled by, where many begin like its title
KEY_CHARS = 12  #: shorter titles say nothing about a document
DEPTH = 512  #: levels of nesting; what is deeper hangs on the element at that level, as in browsers
TAGS, FEATURES, STEPS = 64, 1024, 150

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
log = logging.getLogger(__name__)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg iframe head".split())
_BLOCK = frozenset("address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: What an opening tag ends, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset("html body table td th article section aside nav main div blockquote li footer header".split())


class Dom:
    """The elements of one page in document order, and its text in pieces (number of the element, text, whether a line begins).

    Every step moves on in the source or takes an element off the stack, so the time is linear in the page's
    length whatever stands in it.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.names, self.pieces = ["#page"], [-1], [""], []
        self.stack, self.open, self.scopes = [0], {}, []
        at, fresh, n = 0, True, len(source)
        tags_end, quotes, raw_end = source.rfind(">"), True, {}  # what was found out about the rest of the page
        while at < n:
            end = self._next(source, at, tags_end)
            if end > at:
                text = source[at:end]
                if text.strip():
                    text = html.unescape(text) if "&" in text else text
                    self.pieces.append((self.stack[-1], " ".join(text.split()), fresh, text[:1].isspace()))
                    fresh = False
            if end == n:
                break
            if source[end + 1] in "!?":
                close = source.find("-->", end + 4) if source.startswith("<!--", end) else source.find(">", end)
                at = n if close < 0 else close + (3 if source.startswith("<!--", end) else 1)
                continue
            name = _NAME.match(source, end + 1).group()
            begin = end + 1 + len(name)
            close = _QUOTED.match(source, begin).end() if quotes else n
            if close == n or source[close] != ">":  # a quote that nothing closes: from here on quotes don't count
                quotes, close = False, source.find(">", begin)
            rest, at = source[begin:close], close + 1
            closes, tag = name[0] == "/", name.lstrip("/").lower()
            fresh |= tag in _BLOCK
            if closes:
                k = self._last(tag)
                if k and (tag in _SCOPE or not self.scopes or self.scopes[-1] < k):
                    self._pop(k)
                continue
            if tag in _RAW and not rest.endswith("/"):
                if tag not in raw_end or -1 < raw_end[tag] < at:
                    m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
                    raw_end[tag] = m.start() if m else -1
                if raw_end[tag] >= 0:
                    close = source.find(">", raw_end[tag])
                    at = n if close < 0 else close + 1
                elif tag != "head":
                    at = n
                continue
            if tag in _VOID:
                continue
            more, up_to = _ENDS.get(tag, ((), ()))
            ends = max(self._last(t) for t in (*more, "p")) if tag in _BLOCK else max(map(self._last, more), default=0)
            stop = max(map(self._last, up_to), default=0) if more else self.scopes[-1] if self.scopes else 0
            if ends > stop:
                self._pop(ends)
            self.tag.append(tag)
            self.parent.append(self.stack[min(len(self.stack), DEPTH) - 1])
            self.names.append(" ".join(x for a in _ATTR.finditer(rest) for x in a.groups() if x).lower() if "=" in rest else "")
            if not rest.endswith("/"):
                self.open.setdefault(tag, []).append(len(self.stack))
                if tag in _SCOPE:
                    self.scopes.append(len(self.stack))
                self.stack.append(len(self.tag) - 1)

    @staticmethod
    def _next(source: str, at: int, tags_end: int) -> int:
        """Where the next tag, comment or declaration begins; the source's end if there is none."""
        while (at := source.find("<", at)) >= 0:
            c = source[at + 1 : at + 2]
            if c and c in "!?" or at < tags_end and _NAME.match(source, at + 1):
                return at
            at += 1
        return len(source)

    def _last(self, tag: str) -> int:
        """The place in the stack of the last open element of a tag, 0 if there is none."""
        at = self.open.get(tag)
        return at[-1] if at else 0

    def _pop(self, k: int) -> None:
        for i in range(len(self.stack) - 1, k - 1, -1):
            tag = self.tag[self.stack[i]]
            self.open[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
        del self.stack[k:]


def _bucket(value: str, n: int) -> int:
    h = 2166136261
    for c in value.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return h % n


class Forest:
    """Pages together: parents, depth levels, tags and feature numbers of all nodes."""

    def __init__(self, pages: list[Dom]) -> None:
        sizes = [len(p.tag) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.first[-1])
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, n)
        base = np.repeat(self.first[:-1], sizes)
        self.parent = np.where(parent < 0, -1, parent + base)
        depth = np.zeros(n, np.int64)
        # a parent comes before its children
        for p, at in zip(pages, self.first[:-1].tolist()):
            d = [0] * len(p.tag)
            for i in range(1, len(d)):
                d[i] = d[p.parent[i]] + 1
            depth[at : at + len(d)] = d
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if n else []
        inner = np.zeros(n, np.int64)
        for level in self.levels:
            inner[level] = np.arange(len(level))
        #: of each level but the first the places of the parents in the level above
        self.up = [None, *(inner[self.parent[level]] for level in self.levels[1:])]
        known: dict[str, int] = {}
        tags = [t for p in pages for t in p.tag]
        self.tag = np.array([known[t] if t in known else known.setdefault(t, _bucket(t, TAGS)) for t in tags], np.int64)
        words, links, marks = np.zeros(n), np.zeros(n), np.zeros(n)
        for p, at in zip(pages, self.first[:-1].tolist()):
            inside = [False] * len(p.tag)
            for i in range(1, len(inside)):
                inside[i] = p.tag[i] == "a" or inside[p.parent[i]]
            for i, text, _, _ in p.pieces:
                k = text.count(" ") + 1
                words[at + i] += k
                marks[at + i] += text.count(".") + text.count(",")
                links[at + i] += k * inside[i]
        own = words.copy()
        for k in range(len(self.levels) - 1, 0, -1):
            for x in (words, links, marks):
                x[self.levels[k - 1]] += np.bincount(self.up[k], x[self.levels[k]], len(self.levels[k - 1]))
        children = np.bincount(self.parent[self.parent >= 0], minlength=n)
        log = lambda x: np.minimum(np.log2(x + 1), 15).astype(np.int64)
        share = lambda a, b: np.round(4 * a / np.maximum(b, 1)).clip(0, 7).astype(np.int64)
        place = (np.arange(n) - base) * 4 // np.repeat(np.maximum(sizes, 1), sizes) if n else base
        up = np.maximum(self.parent, 0)
        names = np.array([_bucket(x, 256) if x else 256 for p in pages for x in p.names], np.int64)
        columns = [self.tag, TAGS + self.tag[up], 128 + log(own), 144 + log(words), 160 + share(links, words), 168 + share(12 * marks, words), 176 + np.minimum(depth, 15), 192 + log(children), 208 + place, 212 + share(own, words), 224 + share(links[up], words[up]), 256 + names, 520 + names[up]]
        self.features = np.stack(columns, 1) if n else np.zeros((0, len(columns)), np.int64)
        self.own, self.words = own, words


class Model:
    """``node``: weight of each feature for content; ``edge``: (tags, parent's state, child's state)."""

    def __init__(self, node: np.ndarray, edge: np.ndarray) -> None:
        self.node, self.edge = node, edge


def marginals(f: Forest, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content of each node, and (nodes, 2, 2) of the states of its parent and itself."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = m.node[f.features].sum(1)
    belief, message = own.copy(), np.zeros((n, 2))  # message: to the parent, by the parent's state
    edge = m.edge[f.tag]
    for k in range(len(f.levels) - 1, 0, -1):
        level, above = f.levels[k], f.levels[k - 1]
        x = edge[level] + belief[level][:, None, :]
        message[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        for s in (0, 1):
            belief[above, s] += np.bincount(f.up[k], message[level, s], len(above))
    pair = np.zeros((n, 2, 2))
    whole = belief.copy()
    for level in f.levels[1:]:
        above = whole[f.parent[level]] - message[level]  # the parent without this child
        x = edge[level] + above[:, :, None] + belief[level][:, None, :]
        x -= x.max((1, 2), keepdims=True)
        p = np.exp(x)
        pair[level] = p / p.sum((1, 2), keepdims=True)
        y = edge[level] + above[:, :, None]
        whole[level] = belief[level] + np.logaddexp(y[:, 0], y[:, 1])
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -60, 60))), pair


def train(pages: list[Dom], labels: list[np.ndarray], steps: int = STEPS) -> Model:
    """Conditional maximum likelihood by AdaGrad over all the pages at once; without pages the prior model."""
    m = prior()
    if not pages:
        return m
    f, y = Forest(pages), np.concatenate(labels).astype(np.int64)
    child = f.parent >= 0
    seen = np.zeros((TAGS, 2, 2))
    np.add.at(seen, (f.tag[child], y[f.parent[child]], y[child]), 1)
    acc_n, acc_e = np.full(FEATURES, 1e-6), np.full((TAGS, 2, 2), 1e-6)
    scale = 1 / len(pages)
    for _ in range(steps):
        p, pair = marginals(f, m)
        g = np.bincount(f.features.ravel(), np.repeat(y - p, f.features.shape[1]), FEATURES) * scale - 1e-3 * m.node
        expected = np.stack([np.bincount(f.tag[child], pair[child][:, a, b], TAGS) for a in (0, 1) for b in (0, 1)], 1).reshape(TAGS, 2, 2)
        ge = (seen - expected) * scale - 1e-3 * m.edge
        acc_n += g**2
        acc_e += ge**2
        m.node += 0.3 * g / np.sqrt(acc_n)
        m.edge += 0.3 * ge / np.sqrt(acc_e)
    return m


def prior() -> Model:
    """Where training starts: tags of navigation are boilerplate, long text of few links is content, states agree."""
    node, edge = np.zeros(FEATURES), np.zeros((TAGS, 2, 2))
    for tag, w in {"nav": -2, "footer": -2, "aside": -2, "form": -1, "article": 2, "main": 2, "p": 0.5, "h1": 0.5}.items():
        node[_bucket(tag, TAGS)] += w
    node[163:165] = -1
    edge[:, 0, 0] = edge[:, 1, 1] = 0.7
    return Model(node, edge)


def text_of(page: Dom, content: np.ndarray) -> str:
    out: list[str] = []
    line = False
    for i, text, fresh, spaced in page.pieces:
        line |= fresh
        if content[i]:
            if out:
                out.append("\n" if line else " ")
            out.append(text)
            line = False
    return "".join(out)


_TITLE, _TITLE_END = re.compile(r"<title(?=[\s>])", re.I), re.compile(r"</title", re.I)


def title_of(source: str) -> str:
    """The text of the first title element, "" where there is none or nothing closes it."""
    if not (m := _TITLE.search(source)) or (at := source.find(">", m.end()) + 1) < 1 or not (end := _TITLE_END.search(source, at)):
        return ""
    return " ".join(html.unescape(source[at : end.start()]).split())


def label(page: Dom, texts: list[str]) -> np.ndarray | None:
    """1 for the elements whose text is mostly in one of ``texts``; None where hardly any of it is."""
    known = [" ".join(t.split()) for t in texts]
    n = len(page.tag)
    good, words = np.zeros(n), np.zeros(n)
    for i, text, _, _ in page.pieces:
        k = text.count(" ") + 1
        words[i] += k
        good[i] += k * any(text in t for t in known)
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
        words[page.parent[i]] += words[i]
    return (good > words / 2).astype(np.int64) if good[0] > 0.3 * max(words[0], 1) else None


def labelled_pages(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> list[tuple[str, list[str]]]:
    """(html, texts of the documents that begin like its title) of a bounded sample of the pages that have such documents."""
    title = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>([^<]*)", 1), r"\s+", " "))
    p = pages.where("page_id is not null").select("page_id", F.substring(title, 1, KEY_CHARS).alias("key")).where(F.length("key") == KEY_CHARS)
    d = documents.select("text", F.substring(F.substring_index(F.ltrim("text"), "\n", 1), 1, KEY_CHARS).alias("key")).where(F.length("key") == KEY_CHARS)
    # keys are single values on this side, so a title that many pages have meets one row
    known = cut(p.join(d.select("key").distinct(), "key", "left_semi").select("page_id").distinct())
    picked = bounded_sample(known, "page_id", sample).select("page_id")
    rows = sorted((i, h) for i, h in pages.join(F.broadcast(picked), "page_id").groupBy("page_id").agg(F.min("html")).collect())
    titles = {i: title_of(h) for i, h in rows}
    wanted = sorted({t for t in titles.values() if len(t) >= KEY_CHARS})
    begins = documents.sparkSession.createDataFrame([(t, t[:KEY_CHARS]) for t in wanted], "title string, key string")
    # a title a sampled page: at most ``sample`` rows on this side, and TEXTS hashes of each
    hits = d.join(F.broadcast(begins), "key").where(F.startswith(F.ltrim("text"), F.col("title"))).select("title", F.xxhash64("text").alias("h")).distinct()
    few = F.row_number().over(Window.partitionBy("title").orderBy("h"))
    hits = cut(hits.withColumn("n", few).where(F.col("n") <= TEXTS).select("title", "h"))
    found = d.select("text", F.xxhash64("text").alias("h")).join(F.broadcast(hits.select("h").distinct()), "h").groupBy("h").agg(F.min("text").alias("text"))
    texts: dict[str, list[str]] = {}
    for t, text in hits.join(found, "h").select("title", "text").collect():
        texts.setdefault(t, []).append(text)
    return [(h, sorted(texts[titles[i]])) for i, h in rows if titles[i] in texts]


def fit(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> Model:
    doms, labels = [], []
    for source, texts in labelled_pages(pages, documents, sample):
        page = Dom(source)
        y = label(page, texts)
        if y is not None:
            doms.append(page)
            labels.append(y)
    if not doms:
        log.warning("no page has a title that begins a document: content is judged by the prior model")
    log.info("content model fitted on %d labelled pages", len(doms))
    return train(doms, labels)


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """``(page_id, html)`` -> page_id, title, text, n_nodes, n_content, content_words, words, least_sure: a row for each row.

    ``text`` has the content in document order, a line a block; ``least_sure`` is the marginal nearest to a
    half, as its distance from it. Null and empty html give an empty text and one node. A null page_id is
    kept, repeated rows come out alike, other columns are ignored, an empty table gives no rows. Unclosed and
    misnested tags are repaired as browsers do in the usual cases. Pages of any length are read whole, in time
    proportional to it. Ties (a marginal of a half) are content.
    """
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part, sources in slices(batches, "html"):
            doms = [Dom(s or "") for s in sources]
            f = Forest(doms)
            prob, _ = marginals(f, m)
            prob = np.round(prob, 6)
            content = prob >= 0.5
            bounds = list(zip(f.first[:-1].tolist(), f.first[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([title_of(s or "") for s in sources]), pa.array([text_of(d, content[a:b]) for d, (a, b) in zip(doms, bounds)]),
                    pa.array([b - a for a, b in bounds]), pa.array([int(content[a:b].sum()) for a, b in bounds]),
                    pa.array([int(f.own[a:b][content[a:b]].sum()) for a, b in bounds]), pa.array([int(f.own[a:b].sum()) for a, b in bounds]),
                    pa.array([float(np.abs(prob[a:b] - 0.5).min().round(6)) for a, b in bounds]),
                ],
                ["page_id", "title", "text", "n_nodes", "n_content", "content_words", "words", "least_sure"],
            )

    return p.mapInArrow(run, "page_id bigint, title string, text string, n_nodes bigint, n_content bigint, content_words bigint, words bigint, least_sure double")


def op6_html_content(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, fit(pages, spark.read.parquet(f"{sf_dir}/documents.parquet")))
