"""Main text of web pages by minimum-cut labelling.

1. A page is cut into blocks at its block-level tags; scripts, styles, comments, the
   head and the like are no text.
2. Each block gets a score for being content: a linear classifier of its text (words,
   links, punctuation, case), fitted to the blocks of a bounded sample of pages that stand
   inside landmarks such as ``article`` or ``nav``, plus the evidence of its own landmarks,
   roles and class words.
3. The scores are the capacities from the source (content) or to the sink
   (boilerplate). Edges for smoothness join each block with the next and with the next
   under the same parent; they weigh more the nearer the two are in the document tree. The maximum
   flow leaves the minimum cut; what the source still reaches is content.

The classifier is fitted on at most ``SAMPLE_BLOCKS`` blocks of ``SAMPLE_PAGES`` pages,
chosen by a hash of their id (fixed weights if these have landmarks of one kind only).

A null or empty page, or one without content, has the text "". Unclosed and unopened tags
are tolerated; a line break is white space inside a block. Repeated rows get equal
results; a long page is read whole. Other columns
are kept by ``with_main_text``.
"""

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm.toxicity import fit_logistic

SAMPLE_PAGES = 400
SAMPLE_BLOCKS = 20_000
EVIDENCE = 6.0
SIBLINGS, COUSINS, STRANGERS, SAME_PARENT = 1.5, 0.75, 0.2, 0.5
# Tags by their role, and words of classes, ids and roles.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td textarea tfoot th thead tr ul video audio".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = "script|style|noscript|template|title"
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button select textarea dialog menu iframe label".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription share sharing social "
    "related recommended recommendations sidebar side widget menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion pagination "
    "pager login signin signup register search complementary contentinfo skip hidden dialog form toc copyright legal "
    "disclaimer".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post postbody story text".split())
DEFAULT_WEIGHTS = np.array([0.9, -4.0, 1.0, 0.5, -1.0, 1.0, -1.5, -2.0])  # the intercept last

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<({NO_TEXT})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("parts", "linked", "path", "tag", "evidence", "text")

    def __init__(self, path, tag, evidence):
        self.parts, self.linked = [], 0
        self.path, self.tag, self.evidence = path, tag, evidence


def _evidence(tag: str, attributes: str, above: float, in_content: bool) -> float:
    """Of an element: what it says about its text, else what those above say."""
    words = set()
    hidden = False
    if attributes and "=" in attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "itemprop"):
                words.update(WORD.findall(CAMEL.sub(" ", a or b or c).lower()))
            elif name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
                hidden = True
            elif name == "aria-hidden" and "true" in (a or b or c).lower():
                hidden = True
    if hidden or tag in BOILERPLATE_TAGS or tag == "header" and not in_content or words & BOILERPLATE_WORDS:
        return -EVIDENCE
    if above < 0:
        return above  # an article within a menu is a teaser
    if tag in CONTENT_TAGS:
        return EVIDENCE
    if words & CONTENT_WORDS:
        return max(above, EVIDENCE / 2)
    return above


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in order."""
    # Open elements: tag, number, evidence, inside content, inside a link.
    stack = [("", 0, 0.0, False, False)]
    path = (0,)
    number, at = 0, 0
    found: list[Block] = []
    current = None

    def text(piece):
        nonlocal current
        if not piece or piece.isspace() and current is None:
            return
        top = stack[-1]
        if current is None:
            tag = next((s[0] for s in reversed(stack) if s[0] in BLOCK_TAGS), "")
            current = Block(path, tag, top[2])
            found.append(current)
        current.parts.append(piece)
        if top[4]:
            current.linked += len(piece)

    for m in TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            current = None
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "body") and tag not in ("article", "body", "html"):
                    break  # a stray end tag closes nothing outside
        else:
            if tag in CLOSED_BY_SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "div", "article", "section", "body", "blockquote", "dl", "td"):
                        break
            if tag in VOID_TAGS or m[4].endswith("/"):
                continue
            number += 1
            _, _, above, in_content, in_link = stack[-1]
            stack.append((tag, number, _evidence(tag, m[4], above, in_content),
                          in_content or tag in CONTENT_TAGS, in_link or tag == "a"))
        if block:
            path = tuple(s[1] for s in stack if s[0] in BLOCK_TAGS or not s[0])
    text(page[at:])
    kept = []
    for b in found:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


def features(b: Block) -> list[float]:
    """Of the text alone: size, links, sentence end, commas, capitals, paragraph, item."""
    n = b.text.count(" ") + 1
    return [np.log1p(n), min(1.0, b.linked / len(b.text)), float(b.text[-1] in ".!?…:\"'”"),
            min(1.0, 5 * b.text.count(",") / n), float(b.text.isupper()),
            float(b.tag in ("p", "h1", "h2", "h3", "blockquote", "pre")), float(b.tag in ("li", "td", "th", "div"))]


def _decided(scores: list[float], near: list[dict[int, float]]) -> list[bool | None]:
    """Blocks that the minimum cut labels alike whatever the others get, in linear time.

    A capacity above the sum of a block's edges settles its label; its edges then become
    capacities of its neighbours. Settled blocks are taken out of ``near``.
    """
    label: list[bool | None] = [None] * len(scores)
    reach = [sum(x.values()) for x in near]
    check = deque(range(len(scores)))
    while check:
        i = check.popleft()
        if label[i] is not None or -reach[i] - 1e-9 < scores[i] <= reach[i] + 1e-9:
            continue
        label[i] = scores[i] > 0
        for j, w in near[i].items():
            del near[j][i]
            reach[j] -= w
            scores[j] += w if label[i] else -w
            check.append(j)
        near[i] = {}
    return label


def labels_by_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content or not: the minimum cut of scores (capacities) and edges (both ways).

    Paths are sought among the blocks only that stand against no stronger capacity of their own.
    """
    n = len(scores)
    excess = list(scores)  # above zero from the source, below zero to the sink
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label = _decided(excess, near)
    for first in range(n):
        if label[first] is None:
            group, queue = {first}, deque([first])
            while queue:
                new = [j for j in near[queue.popleft()] if j not in group]
                group.update(new)
                queue.extend(new)
            content = _augment(excess, near, sorted(group))
            for i in group:
                label[i] = i in content
    return label


def _augment(excess: list[float], near: list[dict[int, float]], group: list[int]) -> dict[int, int]:
    """The blocks of a connected group that the source still reaches after the maximum flow."""
    sources = [i for i in group if excess[i] > 0]
    while True:
        # Breadth first from all blocks whose source has capacity left.
        came = {i: i for i in sources if excess[i] > 0}
        queue = deque(came)
        end = None
        while queue and end is None:
            i = queue.popleft()
            for j, room in near[i].items():
                if room > 1e-9 and j not in came:
                    came[j] = i
                    if excess[j] < 0:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            return came
        flow, j = -excess[end], end
        while came[j] != j:
            flow = min(flow, near[came[j]][j])
            j = came[j]
        flow = min(flow, excess[j])
        excess[j] -= flow
        excess[j] = 0.0 if excess[j] < 1e-9 else excess[j]
        j = end
        excess[end] += flow
        excess[end] = 0.0 if excess[end] > -1e-9 else excess[end]
        while came[j] != j:
            i = came[j]
            near[i][j] -= flow
            near[j][i] += flow
            j = i


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1].path
            shared = 0
            for x, y in zip(a, b.path):
                if x != y:
                    break
                shared += 1
            apart = len(a) + len(b.path) - 2 * shared
            edges.append((i - 1, i, SIBLINGS if apart <= 2 else COUSINS if apart <= 3 else STRANGERS))
        before = last.get(b.path[:-1])
        if before is not None and before != i - 1:
            edges.append((before, i, SAME_PARENT))
        last[b.path[:-1]] = i
    return edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores = (np.array([features(b) for b in blocks]) @ weights[:-1] + weights[-1]).clip(-4, 4)
    keep = labels_by_cut((scores + np.array([b.evidence for b in blocks])).tolist(), smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def _block_features(batches):
    for batch in batches:
        rows = []
        for order, page in zip(batch.column("o").to_pylist(), batch.column("html").to_pylist()):
            for i, b in enumerate(blocks_of(page)):
                if abs(b.evidence) == EVIDENCE:
                    rows.append((order, i, features(b), b.evidence > 0))
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.list_(pa.float64())), pa.array([r[3] for r in rows], pa.bool_())],
            ["o", "i", "x", "y"])


def fit(pages: DataFrame, page_id: str = "page_id") -> np.ndarray:
    """Weights of the text classifier, the intercept last."""
    chosen = pages.where("html IS NOT NULL").select(F.xxhash64(page_id).alias("o"), "html").orderBy("o").limit(SAMPLE_PAGES)
    rows = chosen.mapInArrow(_block_features, "o long, i long, x array<double>, y boolean").orderBy("o", "i").limit(
        SAMPLE_BLOCKS).collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return DEFAULT_WEIGHTS
    return fit_logistic(np.array([r["x"] for r in rows]), y)




def with_main_text(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """``pages`` with a column ``main_text``; one of that name is replaced."""
    pages = pages.drop("main_text")
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), F.col("html").alias("_html"))

    def run(batches):
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                texts = [main_text(h, weights) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_page"), pa.array(texts, pa.string())], ["_page", "main_text"])

    return packed.mapInArrow(run, f"_page {packed.dtypes[0][1]}, main_text string").select(
        *[F.col("_page")[c].alias(c) for c in pages.columns], "main_text")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return with_main_text(pages.select("page_id", "url", "html"), fit(pages)).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
