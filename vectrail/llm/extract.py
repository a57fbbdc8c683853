"""Main text of web pages by minimum cut.

A page is cut into text blocks. A linear classifier turns the evidence of a block (the elements and class words
above it, share of linked text, length) into a cost for calling it boilerplate and a cost for calling it content:
the capacities to the two terminals. Neighbouring blocks are tied by smoothness edges that are stronger the more
of their ancestors they share, and so are blocks of one container that are parted by something else. The minimum
cut, found by maximum flow (Dinic), is the cheapest labelling. Neighbours in one container whose costs lean the
same way are one node, since no minimum cut parts them.

The text: character references decoded, white space inside a block one space, blocks trimmed and joined in page
order by a line feed, nothing else dropped. A line break element is white space.

Defined results: null, empty or textless html gives an empty text; unclosed, crossed and stray tags follow the
usual recovery (a new paragraph ends the open one, an end tag without a start is ignored); an unclosed script,
style or comment swallows the rest, nothing else does; repeated rows each get a row; an empty table gives an empty result; extra
columns are ignored. Work is linear in the html apart from the flow over the page's few nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)|<[!?/][^>]*+>|([^<]++|<)""",
    re.S | re.I,
)
#: Elements that are left out with what they hold, if they are closed; an open one is just a tag.
DROPPED = {x: re.compile(rf"</{x}\s*>", re.I) for x in "title textarea template svg iframe select button".split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(["hr"])
#: An opening tag ends an open element of these names, up to the nearest of the containers.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("article aside body dl fieldset figure footer form header html main menu nav ol section table ul div blockquote".split())
AGAINST_TAGS = frozenset("nav aside footer form menu dialog head fieldset".split())
FOR_TAGS = frozenset(["article", "main"])
#: Words of class, id and role that speak against content, and for it; parameters of the classifier.
AGAINST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent contentinfo complementary cookie cookies copyright dialog discussion disqus "
    "footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply "
    "respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
FOR_WORDS = frozenset("article articlebody content entry main post story text".split())
W_AGAINST, W_FOR, W_HEADER, W_LINKS, W_LENGTH, W_START = 8.0, 4.0, 4.0, 4.0, 0.04, -0.75
TIE_NEXT, TIE_SAME = 0.5, 0.5
#: Evidence that hides everything below, whatever speaks for it further down.
FIRM = 6.0


def class_words(values: list[str]) -> set[str]:
    """Words of class, id and role: whole names, and the parts of compound ones. A compound that has a word for content and
    ``header``, or ``free`` or ``result``, speaks of the content's own parts, not against it."""
    out: set[str] = set()
    for name in " ".join(values).lower().split():
        parts = set(re.split(r"[^a-z0-9]+", name)) - {""}
        if len(parts) > 1 and ("free" in parts or parts & {"result", "results"} or "header" in parts and parts & FOR_WORDS):
            parts -= AGAINST_WORDS
        out |= parts
    return out


class Page:
    """Blocks of a page: text, score (over 0: content), container and its ancestors."""

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[str, float, tuple]] = []
        # an open element: name, evidence so far, inside an article, path
        self.stack: list[tuple[str, float, bool, tuple]] = [("", 0.0, False, None)]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.links = 0
        at, unclosed = 0, set()
        while m := TOKEN.search(html, at):
            at = m.end()
            text = m[6]
            if m[5] == "":  # a tag without an end, hence without any further tag: text
                self.parts.append(html[m.start():])
                break
            if text is not None:
                self.parts.append(text)
                if self.links and len(text) > 1:
                    self.linked += len(text)
            elif m[3] is not None:
                name = m[3].lower()
                if name in DROPPED:
                    if not m[2] and not m[4].endswith("/") and name not in unclosed:
                        end = DROPPED[name].search(html, at)
                        if end:
                            at = end.end()
                        else:
                            unclosed.add(name)  # nor has a later one an end
                elif name == "a":
                    self.links = 0 if m[2] else 1
                elif name in BLOCKS:
                    self.flush()
                    if m[2]:
                        self.end({name})
                    elif name not in VOID:
                        self.start(name, m[4])
                elif name == "br":
                    self.parts.append(" ")
        self.flush()

    def end(self, names: set[str], within: frozenset = frozenset()) -> None:
        if any(self.open[x] for x in names):
            i = len(self.stack) - 1
            while i and self.stack[i][0] not in names:
                if self.stack[i][0] in within:
                    return
                i -= 1
            for name, *_ in self.stack[max(i, 1):]:
                self.open[name] -= 1
            del self.stack[max(i, 1):]

    def start(self, name: str, attributes: str) -> None:
        self.end(ENDS.get(name, {"p"}) | {"p"} if name != "p" else {"p"}, CONTAINERS)
        _, evidence, inside, path = self.stack[-1]
        words = class_words([m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)]) if attributes and "=" in attributes else ()
        if name in AGAINST_TAGS or words and not AGAINST_WORDS.isdisjoint(words) and name not in ("body", "html", "main", "article"):
            evidence = min(evidence, 0.0) - W_AGAINST
        elif name == "header" and not inside:
            evidence -= W_HEADER
        elif name in FOR_TAGS or words and not FOR_WORDS.isdisjoint(words):
            inside = True
            evidence = evidence if evidence <= -FIRM else max(evidence, 0.0) + W_FOR
        self.open[name] += 1
        self.stack.append((name, evidence, inside, (path, len(self.stack), object())))

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                name, evidence, _, path = self.stack[-1]
                holder = path[0] if path and name not in CONTAINERS else path
                score = evidence + W_START + min(W_LENGTH * len(text), 3.0) - W_LINKS * min(1.0, self.linked / max(1, len(text))) + (1.5 if name in ("h1", "h2", "p") else 0.0)
                self.blocks.append((text, score, holder))
            self.parts = []
            self.linked = 0


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that cost least: |score| for each label against it, an edge's weight where labels differ."""
    n = len(scores)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []
    def tie(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        cap.append(there)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)
    for i, s in enumerate(scores):
        tie(source, i, s, 0.0) if s > 0 else tie(i, sink, -s, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        while True:  # one blocking flow, without recursion
            path, u = [], source
            while u != sink:
                while at[u] < len(graph[u]):
                    e = graph[u][at[u]]
                    if cap[e] > tiny and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(e)
                u = to[e]
            if u != sink:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def _shared(a: tuple | None, b: tuple | None) -> float:
    """Share of their ancestors that two containers have in common."""
    if a is b:
        return 1.0
    most = max(a[1] if a else 0, b[1] if b else 0)
    while a is not b:
        if b is None or a is not None and a[1] >= b[1]:
            a = a[0]
        else:
            b = b[0]
    return (a[1] if a else 0) / max(1, most)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = Page(html).blocks
    groups: list[list] = []  # score, container, texts
    for text, score, holder in blocks:
        if groups and groups[-1][1] is holder and (groups[-1][0] > 0) == (score > 0):
            groups[-1][0] += score
            groups[-1][2].append(text)
        else:
            groups.append([score, holder, [text]])
    edges = [(i, i + 1, TIE_NEXT * _shared(groups[i][1], groups[i + 1][1])) for i in range(len(groups) - 1)]
    last: dict[int, int] = {}
    for i, (_, holder, _) in enumerate(groups):
        j = last.get(id(holder))
        if j is not None and holder is not None:
            edges.append((j, i, TIE_SAME))
        last[id(holder)] = i
    labels = min_cut([g[0] for g in groups], edges)
    return "\n".join(text for g, content in zip(groups, labels, strict=True) if content for text in g[2])


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op2_extract": op2_extract}
SQL: dict[str, str] = {}
