"""Main text of web pages by minimum-cut labelling (operator 8).

A page is read into blocks: the text between two block-level tags, with the elements that enclose it. A logistic
classifier, fitted to labelled blocks (fit()), weighs a block by its own text (length, share of links, how it ends, the
element it is in) and by what its enclosing elements say of themselves (names, class and id words). What an element says
counts only as far as it can be meant for its text: state words ("has-sidebar") and the words of html and body say
nothing, and an element with most of the page's unlinked text is no menu, form or notice whatever it is called. The log-odds are the terminal capacities: positive ones from the source, negative ones to the sink.
Neighbouring blocks and blocks of one container are joined by smoothness edges. The blocks on the source's side of the
minimum cut are the main text. Pages are independent: no shuffle, and a task holds one batch.

Defined cases: null html is empty; broken and cut-off markup is read as far as it goes (an open comment, script or tag
ends with the page); a page without content has the empty string; page_id and url may be null; rows may repeat.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.batches import AT_A_TIME, few_rows

# What stands in a tag after its name: a quotation mark opens a value only right after an equals sign, and only if it is
# closed; elsewhere it is a letter like any other. Nothing is read twice.
_INNER = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select)(?=[\s/>]|\Z){_INNER}(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INNER})(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_NAMING = frozenset("class id role itemprop".split())
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W_]")
_SENTENCE_END = re.compile(r"""[.!?…:;。！？]["'”’»)\]]*$""")

BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
ITEMS = frozenset("li dd dt td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's name says; "frame" may also be wrapped around a whole page.
MEANING = {
    **dict.fromkeys("nav footer aside menu dialog button legend fieldset".split(), "rest"),
    **dict.fromkeys("form header".split(), "frame"),
    **dict.fromkeys("article main".split(), "main"),
    **dict.fromkeys("head title".split(), "never"),
}
#: What the words of class, id and role say.
WORDS = {
    "comments": "comment comments commentlist respond reply replies disqus discussion kommentar kommentare commentaire commentaires comentario comentarios".split(),
    "frame": "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer foot copyright masthead topbar toolbar pagination pager widget widgets related recommended recommendations share sharing social search skip complementary contentinfo alertdialog form header werbung anzeige fusszeile publicite publicidad pie".split(),
    "main": "article content post entry story articlebody main text body artikel inhalt contenu contenido".split(),
}
_SAYS = {w: kind for kind, words in WORDS.items() for w in words}
#: A name with one of these words in it tells a state of its element, not what it is.
STATES = frozenset("has no not is with without js enabled disabled active visible open closed".split())
#: Share of a page's unlinked text beyond which an element is taken for the page's frame: if it holds an article, if not.
MOST = (0.5, 0.8)

FEATURES = ("one", "length", "linked", "sentence", "paragraph", "heading", "item", "in main", "in rest", "in frame", "in comments", "main words", "never", "wordless", "linked in main")
#: Weights of FEATURES: log-odds of being content, fitted to the labelled pages of the tests.
WEIGHTS = {"one": -0.48, "length": 0.58, "linked": -8.25, "sentence": 1.49, "paragraph": 2.76, "heading": 4.18, "item": 3.69, "in main": 1.65, "in rest": -8.44, "in frame": -11.15, "in comments": -10.83, "main words": 3.28, "never": -5.61, "wordless": -2.47, "linked in main": 7.24}
NEIGHBOUR, SIBLING, SCALE = 0.4, 0.6, 1000


def meaning(tag: str, attributes: str) -> tuple[str, str]:
    """What an element's name and its words say: "", "main", "rest", "frame", "comments" or "never"."""
    said = ""
    if attributes and tag not in ("html", "body"):
        kinds = set()
        for m in _ATTRIBUTE.finditer(attributes):
            for name in m[2].strip("\"'").lower().split() if m[2] and m[1].lower() in _NAMING else ():
                words = _WORD.findall(name)
                if STATES.isdisjoint(words):
                    kinds.update(_SAYS[w] for w in words if w in _SAYS)
        said = next((k for k in ("comments", "frame", "main") if k in kinds), "")
    return MEANING.get(tag, ""), said


class Page:
    """A page's blocks, in order, and its block-level elements."""

    def __init__(self, page: str) -> None:
        self.texts: list[str] = []
        self.places: list[tuple[int, float]] = []  # of each block: its element and its share of links
        self.names, self.parents, self.says = [""], [0], [("", "")]
        self.plain = [0]  # unlinked characters of blocks directly in each element
        self._read(page)
        self._weigh()

    def _read(self, page: str) -> None:
        stack: list[int] = [0]
        opened: Counter[str] = Counter()  # names in the stack
        parts: list[str] = []
        linked = link = 0

        def close() -> None:
            nonlocal linked
            if parts:
                raw = entities.unescape("".join(parts))
                if text := " ".join(raw.split()):
                    self.texts.append(text)
                    share = min(1.0, linked / max(1, len(raw)))
                    self.places.append((stack[-1], share))
                    if share < 0.5:
                        self.plain[stack[-1]] += len(text)
                parts.clear()
            linked = 0

        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                piece = page[at : m.start()]
                parts.append(piece)
                if link:
                    linked += len(piece)
            at = m.end()
            name = m[3]
            if name is None:
                if m[0] == "<":
                    parts.append("<")
                continue
            name = name.lower()
            if name == "br":
                parts.append("\n")
            elif name == "a":
                link = 0 if m[2] else 1
            elif name in BLOCKS:
                close()
                if m[2]:
                    while opened[name]:
                        last = self.names[stack.pop()]
                        opened[last] -= 1
                        if last == name:
                            break
                    continue
                if name == "hr":
                    continue
                # a paragraph ends where a block begins; an item where the next does
                if self.names[stack[-1]] == "p" or (self.names[stack[-1]] == name and (name in ITEMS or name == "tr")):
                    opened[self.names[stack.pop()]] -= 1
                self.parents.append(stack[-1])
                self.names.append(name)
                self.says.append(meaning(name, m[4]))
                self.plain.append(0)
                stack.append(len(self.names) - 1)
                opened[name] += 1
        if at < len(page):
            parts.append(page[at:])
        close()

    def _weigh(self) -> None:
        """What counts of what each element and those around it say."""
        n = len(self.names)
        under, holds = list(self.plain), [False] * n
        for i in range(n - 1, 0, -1):
            if self.says[i][0] != "never":
                under[self.parents[i]] += under[i]
            if holds[i] or (self.names[i] in ("article", "main") and self.says[i][1] in ("", "main") and under[i]):
                holds[self.parents[i]] = True
        whole = max(1, under[0])
        self.around: list[frozenset[str]] = [frozenset()]
        for i in range(1, n):
            tag, said = self.says[i]
            above = self.around[self.parents[i]]
            frame = under[i] > MOST[not holds[i]] * whole
            own = set()
            if tag == "main":
                own.add("main")
            elif tag == "never" or (tag == "rest" and not (frame and holds[i])) or (tag == "frame" and not frame and not (self.names[i] == "header" and "main" in above)):
                own.add(tag)
            if said == "comments" or (said == "frame" and not frame):
                own.add(said)
            elif said == "main":
                own.add("main words")
            self.around.append(above | own if own else above)

    def features(self) -> np.ndarray:
        """A row of FEATURES for each block."""
        said = {a: tuple(k in a for k in ("main", "rest", "frame", "comments", "main words", "never")) for a in set(self.around)}
        mains = {a: not a.isdisjoint(("main", "main words")) and a.isdisjoint(("rest", "frame", "comments")) for a in said}  # links that an article has itself
        end, word, rows = _SENTENCE_END.search, _LETTER.search, []
        for text, (element, share) in zip(self.texts, self.places, strict=True):
            name = self.names[element]
            rows.append((1, min(2.0, len(text) / 100), share * share, end(text[-6:]) is not None, name == "p", name in HEADINGS, name in ITEMS, *said[self.around[element]], word(text) is None, share * share * bool(mains[self.around[element]])))
        return np.array(rows, float).reshape(-1, len(FEATURES))

    def edges(self) -> list[tuple[int, int, float]]:
        """Between neighbours, and between the blocks of one container."""
        out, last = [], {}
        for i, (element, _) in enumerate(self.places):
            inner = self.names[element] in ITEMS or self.names[element] in HEADINGS or self.names[element] in ("p", "blockquote", "pre")
            container = self.parents[element] if inner else element
            if i:
                out.append((i - 1, i, NEIGHBOUR))
            if container in last:
                out.append((last[container], i, SIBLING))
            last[container] = i
        return out


def fit(features: np.ndarray, content: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic classifier of blocks, by Newton's method with a ridge penalty."""
    w = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-features @ w))
        grad = features.T @ (p - content) + ridge * w
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut (the smallest such set): node i is joined to the source by
    max(odds, 0), to the sink by max(-odds, 0), and to others by undirected edges.

    A node whose terminal outweighs all its edges is on that terminal's side in any case; it leaves the graph, and its
    edges become capacities of its neighbours. What remains is separated by maximum flow.
    """
    left = [round(o * SCALE) for o in odds]
    near: list[dict[int, int]] = [{} for _ in odds]
    for a, b, w in edges:
        c = round(w * SCALE)
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * len(left)
    queue = list(range(len(left)))
    while queue:
        i = queue.pop()
        if side[i] is None:
            total = sum(near[i].values())
            if left[i] > total or -left[i] >= total:
                side[i] = left[i] > total
                for j, c in near[i].items():
                    del near[j][i]
                    left[j] += c if side[i] else -c
                    queue.append(j)
                near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        for i, s in zip(rest, _flow(rest, left, near), strict=True):
            side[i] = s
    return side


def _flow(nodes: list[int], left: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Which nodes can still be reached from the source after a maximum flow: blocking flows along shortest paths."""
    while True:
        queue = [i for i in nodes if left[i] > 0]
        level = dict.fromkeys(queue, 0)
        ends = False
        for i in queue:
            for j, c in near[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
                    ends |= left[j] < 0
        if not ends:
            return [i in level for i in nodes]
        arcs = {i: iter([j for j in near[i] if level.get(j) == level[i] + 1]) for i in level}
        for source in [i for i in level if left[i] > 0 and not level[i]]:
            path = [source]
            while path and left[source] > 0:
                i = path[-1]
                if left[i] < 0:
                    flow = min(left[source], -left[i], *(near[a][b] for a, b in zip(path, path[1:])))  # noqa: B905
                    left[source] -= flow
                    left[i] += flow
                    keep = len(path)
                    for k in range(len(path) - 2, -1, -1):
                        a, b = path[k], path[k + 1]
                        near[a][b] -= flow
                        near[b][a] += flow
                        if not near[a][b]:
                            keep = k + 1
                    del path[keep:]
                    continue
                step = next((j for j in arcs[i] if near[i][j] > 0), None)
                if step is None:
                    path.pop()
                else:
                    path.append(step)


def main_text(page: str | None) -> str:
    p = Page(page or "")
    if not p.texts:
        return ""
    odds = (p.features() @ np.array([WEIGHTS[f] for f in FEATURES])).tolist()
    return "\n".join(t for t, k in zip(p.texts, min_cut(odds, p.edges()), strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep and text: the main text of each page."""
    own = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                texts = pa.array([main_text(p) for p in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], [*keep, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return few_rows(own).mapInArrow(run, f"{kinds}, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
