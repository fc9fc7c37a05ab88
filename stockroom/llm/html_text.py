"""Operator 6: main text of web pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf path of tag names.
Per path the operator adds up text length, punctuation and nodes; a path's ratio
is its text length per node, its punctuation ratio its punctuation per node.
Both are smoothed over the sequence of nodes in page order (a Gaussian window),
averaged back to their paths and fused by multiplying; paths above a threshold
(a share of the spread of all paths' values) are content.  The smallest container that
holds nearly all their text is the article: its other paths (headings, lists,
tables) belong to it whatever their ratio.  Outside it, nodes of content paths that stand right
in an element around it belong to it too (a lede beside the body), and so does all between
it and the title before it (a byline), when it has no title of its own.

Elements that are boilerplate by their tag or are hidden are left out with all they hold.  A
word of an element's class, id or role (sidebar, comments) leaves it out too, but not
in headings, not in elements around most of the text (of article and main, if any), and,
where it is only a part of an id inside such an article (an anchor such as legal-notice), not
if the element's text and punctuation per block reach half of the article's own.

Text of a block is joined with white space turned into one space and trimmed;
blocks follow in page order, joined by two newlines.  Inline tags and line breaks
do not end a block.

Defined results: a null, empty or text-less html gives an empty text; unclosed,
misnested and unknown tags never fail; repeated rows are treated alike; null
page_id or url pass through; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stockroom.llm.common import slices, table

TEXT_BYTES = 4_000_000
SMOOTHING = np.array([0.05, 0.25, 0.4, 0.25, 0.05])  # Gaussian weights over neighbouring nodes
SPREAD_SHARE = 0.5  # content threshold: this share of the standard deviation of the paths' values

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose start ends an open element of the same group, up to the group's container.
CLOSES = {
    **{name: (frozenset(["li"]), frozenset(["ul", "ol", "menu"])) for name in ["li"]},
    **{name: (frozenset(["dt", "dd"]), frozenset(["dl"])) for name in ["dt", "dd"]},
    **{name: (frozenset(["td", "th"]), frozenset(["table", "tr"])) for name in ["td", "th"]},
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
BOILERPLATE_TAGS = frozenset("nav footer aside form button head menu dialog".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe signup login "
    "share sharing social related recommended comment comments disqus reply replies widget copyright legal disclaimer pagination pager "
    "toolbar toc contentinfo complementary search".split()
)
OTHERS_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus reply replies cookie cookies consent".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLE = frozenset(["h1"])
CONTENT_TAGS = frozenset(["article", "main"])
CONTAINERS = frozenset("html body article main section div center td".split())
REACH = 0.5  # share of the article's text and punctuation per block that an element with a telling id must have to stay
MOST_TEXT = 0.9  # share of the content paths' text that the article must hold

# A quote opens a value only right after "="; an unquoted value may hold quotes.
_VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:{_VALUE}|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")


@dataclass
class Node:
    """A run of text: the elements around it (tag and number), its tag path and its block."""

    text: str
    elements: tuple[tuple[str, int], ...]
    path: str
    block: int
    named: tuple[int, ...] = ()  # numbers of the elements around it with a boilerplate word
    hinted: tuple[int, ...] = ()  # those of them where the word is only a part of an id


@dataclass
class Element:
    tag: str
    skipped: bool  # boilerplate, or inside it
    path: str
    around: tuple[tuple[str, int], ...] = field(default=())
    named: tuple[int, ...] = ()
    hinted: tuple[int, ...] = ()


def attribute_values(attributes: str) -> dict[str, str]:
    """Values by lower-case attribute name; of a repeated one the first."""

    values: dict[str, str] = {}
    for name, *quoted in _ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), html.unescape("".join(quoted)))
    return values


def is_boilerplate(tag: str, attributes: dict[str, str], inside: list[Element]) -> bool:
    if tag in BOILERPLATE_TAGS:
        return True
    if tag == "header" and not any(e.tag in CONTENT_TAGS for e in inside):
        return True
    if tag in ("html", "body"):
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_DISPLAY_NONE.search(attributes.get("style", "")))


def boilerplate_name(tag: str, attributes: dict[str, str]) -> str | None:
    """"whole" if a class or role has a boilerplate word or an id is one, "part" if only an id of several words has one.

    Headings and the page's own elements name what they are about, not what they are.
    """

    if tag in HEADINGS or tag in ("html", "body"):
        return None
    found = None
    for kind in ("class", "id", "role"):
        for name in attributes.get(kind, "").split():
            words = {word.lower() for word in _WORD.findall(name)}
            if words & BOILERPLATE_WORDS:
                section = kind == "id" and len(words) > 1 and not words & OTHERS_WORDS
                found = found or "part" if section else "whole"
    return found


def text_nodes(page: str) -> list[Node]:
    """Text nodes outside boilerplate, in page order."""

    nodes: list[Node] = []
    stack = [Element("#", False, "")]
    count = block = position = 0

    def text(run: str) -> None:
        if run and not stack[-1].skipped:
            nodes.append(Node(html.unescape(run), stack[-1].around, stack[-1].path, block, stack[-1].named, stack[-1].hinted))

    def close_to(depth: int) -> None:
        del stack[depth:]

    match = _TAG.search(page)
    while match:
        text(page[position : match.start()])
        position = match.end()
        closing, name, attributes = match.groups()
        if name is None:
            if match.group().startswith("<![CDATA["):
                text(match.group()[9:].removesuffix("]]>"))
            match = _TAG.search(page, position)
            continue
        tag = name.lower()
        if tag in BLOCK:
            block += 1
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth and (tag in BLOCK or not any(e.tag in BLOCK for e in stack[depth + 1 :])):
                close_to(depth)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, position)
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                position = end.end() if end else len(page) if tag in ("script", "style") else position
        elif tag in ("br", "hr"):
            text(" ")
        elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK):
            if tag in BLOCK:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if depth and not any(e.tag in BLOCK for e in stack[depth + 1 :]):
                    close_to(depth)
            if tag in CLOSES:
                ended, within = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ended:
                        close_to(i)
                        break
            top, count = stack[-1], count + 1
            values = attribute_values(attributes) if attributes else {}
            skipped = top.skipped or is_boilerplate(tag, values, stack)
            name = boilerplate_name(tag, values) if values else None
            named = (*top.named, count) if name else top.named
            hinted = (*top.hinted, count) if name == "part" else top.hinted
            stack.append(Element(tag, skipped, f"{top.path}/{tag}", (*top.around, (tag, count)), named, hinted))
        match = _TAG.search(page, position)
    text(page[position:])
    return without_named(nodes)


def without_named(nodes: list[Node]) -> list[Node]:
    """Without the nodes that the name of an element around them leaves out."""

    marked = [node for node in nodes if node.text.strip() and any(tag in CONTENT_TAGS for tag, _ in node.elements)]
    counted = marked or [node for node in nodes if node.text.strip()]  # with an article or main element, it is that text which counts
    held, marks, blocks = defaultdict(int), defaultdict(int), defaultdict(set)
    for node in counted:
        for element in node.named:
            held[element] += len(node.text.strip())
            marks[element] += len(_PUNCTUATION.findall(node.text))
            blocks[element].add(node.block)
    # an element around most of the text is the page, whatever it is called
    most = sum(len(node.text.strip()) for node in counted) / 2
    plain = [node for node in counted if all(held[element] > most for element in node.named)]
    n = max(len({node.block for node in plain}), 1)
    length = sum(len(node.text.strip()) for node in plain) / n
    punctuation = sum(len(_PUNCTUATION.findall(node.text)) for node in plain) / n
    hinted = {element for node in marked for element in node.hinted}

    def stays(element: int) -> bool:
        if held[element] > most:
            return True
        size = len(blocks[element])
        return element in hinted and held[element] >= REACH * length * size and marks[element] >= REACH * punctuation * size

    return [node for node in nodes if all(map(stays, node.named))]


def path_values(nodes: list[Node]) -> dict[str, float]:
    """Fused, smoothed ratio of each tag path."""

    length, punctuation, n = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in nodes:
        length[node.path] += len(node.text.strip())
        punctuation[node.path] += len(_PUNCTUATION.findall(node.text))
        n[node.path] += 1
    by_text = np.array([length[node.path] / n[node.path] for node in nodes])
    by_marks = np.array([punctuation[node.path] / n[node.path] for node in nodes])
    margin = len(SMOOTHING) // 2
    fused = 1.0
    for ratios in (by_text, by_marks):
        fused = fused * np.convolve(np.pad(ratios, margin, mode="edge"), SMOOTHING, mode="valid")
    total = defaultdict(float)
    for node, value in zip(nodes, fused, strict=True):
        total[node.path] += value
    return {path: total[path] / n[path] for path in n}


def content_nodes(nodes: list[Node]) -> list[Node]:
    """Nodes of the article: the smallest container around nearly all text of the content
    paths, widened to the article (else main) element that it lies in, if there is one."""

    full = [node for node in nodes if node.text.strip()]
    if not full:
        return []
    values = path_values(full)
    threshold = min(SPREAD_SHARE * float(np.std(list(values.values()))), max(values.values()))
    content = [node for node in full if values[node.path] >= threshold]
    weight: dict[tuple[tuple[str, int], ...], int] = defaultdict(int)
    for node in content:
        for level, (tag, _) in enumerate(node.elements):
            if tag in CONTAINERS:
                weight[node.elements[: level + 1]] += len(node.text)
    whole = sum(len(node.text) for node in content)
    around = max((chain for chain, held in weight.items() if held >= MOST_TEXT * whole), key=len, default=())
    for name in ("article", "main"):
        if found := [level for level, (tag, _) in enumerate(around) if tag == name]:
            around = around[: found[0] + 1]
            break
    return beside(nodes, around, {path for path, value in values.items() if value >= threshold})


def beside(nodes: list[Node], around: tuple[tuple[str, int], ...], content: set[str]) -> list[Node]:
    """Nodes of the container ``around``, with its title, what stands between both, and content right in the elements around it."""

    inside = [node.elements[: len(around)] == around for node in nodes]
    start = inside.index(True)
    outer = [around[:level] for level in range(1, len(around)) if around[level - 1][0] not in ("html", "body")]
    chosen = [own or (node.path in content and node.elements[:-1] in outer) for node, own in zip(nodes, inside, strict=True)]

    def has(node: Node, tags: frozenset[str]) -> bool:
        return bool(node.text.strip()) and any(tag in tags for tag, _ in node.elements)

    for tags in (TITLE, HEADINGS):
        if any(own and has(node, tags) for node, own in zip(nodes, inside, strict=True)):
            break  # the container has a title of its own
        if titles := [i for i in range(start) if has(nodes[i], tags) and nodes[i].elements[: title_level(nodes[i])] in outer]:
            last = nodes[titles[-1]]
            first = next(i for i in titles if nodes[i].block == last.block)
            chosen[first:start] = [True] * (start - first)
            break
    return [node for node, keep in zip(nodes, chosen, strict=True) if keep]


def title_level(node: Node) -> int:
    """How many elements lie around the heading that a node is in."""

    return next(level for level, (tag, _) in enumerate(node.elements) if tag in HEADINGS)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks: dict[int, list[str]] = {}
    for node in content_nodes(text_nodes(page)):
        blocks.setdefault(node.block, []).append(node.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(block for block in joined if block)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of (page_id, url, html): page_id, url, text, n_chars; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, TEXT_BYTES):
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64(), size=len(texts))]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
