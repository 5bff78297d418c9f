"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is cut into words and tags in one linear pass. Each element gives evidence for or against what it holds: log odds of
its tag, role, names and share of links, learned from labelled pages (``html_pages``). Evidence adds up from the root to a
word, between bounds, so that an inner element can turn off what an outer one turned on. Words score
positive or negative by it and tags negative, and one linear scan finds the contiguous region with the largest sum. Words
of the region without positive evidence (menus, notices, adverts, forms, comments ... inside the article) stay out, and the rest is put
together block by block; a word that stays out does not end its block.

Defined results: a null or empty page, or one without a positive word, has empty text. What is hidden (``hidden``, ``aria-hidden``, no display) or not
text (scripts, styles, pictures, selections) is out whatever surrounds it. Tags left open, closed twice or
badly nested are read as a browser would, nearly: a closing tag without its opening one is ignored, an unclosed quote ends with its tag, and
a ``<`` that begins no tag is text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.llm.html_pages import LABELLED
from chronolode.llm.tables import read

SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'=<]*)([^>\"']*)>")
TAG_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.IGNORECASE) for n in ("script", "style", "title", "textarea")}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = frozenset(("br", "td", "th"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that ends an open one of the first group, unless one of the second has begun since.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
NO_TEXT = frozenset("svg math select object canvas video audio template noscript iframe datalist".split())
FRAMES = frozenset(("article", "main"))
#: Elements that say by their tag what they hold; of others only names, roles and links count.
CONTAINERS = frozenset("article main section aside nav header footer form div menu dialog button fieldset label details head".split())
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-hidden|style|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?<![\w-])(hidden)(?![\w-])(?!\s*=)", re.IGNORECASE)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BASE, LOW, HIGH, BESIDE, FRAME_SHARE, MANY_LINKS = 0.5, -4.0, 1.5, 2.5, 0.2, 3
OUT = -100.0  # evidence that nothing outweighs


class Element(NamedTuple):
    name: str
    attributes: str
    parent: int  # -1 for the root
    framed: bool


class Page(NamedTuple):
    """Tokens (kind '<', '>' or 't', with name or text, and the element that holds it) and, by element, its words, linked words and links."""

    tokens: list[tuple[str, str, int]]
    elements: list[Element]
    words: list[int]
    linked: list[int]
    links: list[int]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind '<', '>' or 't'. Comments and raw elements (scripts ...) are gone.

    Linear: a quote from which no tag's end can be reached is remembered, so none is followed twice.
    """
    last = page.rfind(">")
    hopeless: set[int] = set()
    at = text = 0
    while (at := page.find("<", at)) >= 0:
        if at > last:
            break
        simple = SIMPLE_TAG.match(page, at)
        if simple:
            end, (closing, name, attributes) = simple.end(), simple.groups()
        elif page.startswith("<!--", at):
            if at > text:
                yield "t", page[text:at], ""
            found = page.find("-->", at + 2)
            at = text = found + 3 if found >= 0 else len(page)
            continue
        elif page.startswith(("<!", "<?"), at):
            if at > text:
                yield "t", page[text:at], ""
            at = text = page.find(">", at) + 1
            continue
        else:
            start = TAG_START.match(page, at)
            if not start:
                at += 1
                continue
            passed, end = [], start.end()
            while True:
                stop = STOP.search(page, end) if end <= last else None
                if stop and stop[0] == ">":
                    end = stop.end()
                    break
                shut = page.find(stop[0], stop.end()) if stop and stop.start() not in hopeless else -1
                if stop:
                    passed.append(stop.start())
                if shut < 0:
                    hopeless.update(passed)
                    end = page.find(">", start.end()) + 1
                    break
                end = shut + 1
            if not end:
                break
            (closing, name), attributes = start.groups(), page[start.end() : end - 1]
        if at > text:
            yield "t", page[text:at], ""
        at = text = end
        name = name.lower()
        if name in RAW_END:
            if not closing:
                found = RAW_END[name].search(page, at)
                at = text = found.end() if found else len(page)
            continue
        yield (">" if closing else "<"), name, attributes
    rest = page.find("<!--", max(at, text)) if at >= 0 else -1  # a comment without end
    if text < (rest if rest >= 0 else len(page)):
        yield "t", page[text : rest if rest >= 0 else len(page)], ""


def parsed(page: str) -> Page:
    """The elements of a page, with open ones on a stack; each is opened and closed once."""
    out: list[tuple[str, str, int]] = []
    elements = [Element("html", "", -1, False)]
    words, linked, links = [0], [0], [0]
    stack = [0]
    places: dict[str, list[int]] = {}  # of open elements on the stack, by name
    blocks = [0]  # places of open block elements other than p
    in_links = 0

    def innermost(*names: str) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def pop(to: int) -> None:
        nonlocal in_links
        while len(stack) > to:
            gone = stack.pop()
            e = elements[gone]
            places[e.name].pop()
            in_links -= e.name == "a"
            if blocks[-1] == len(stack):
                blocks.pop()
            words[e.parent] += words[gone]
            linked[e.parent] += linked[gone]
            links[e.parent] += links[gone] + (e.name == "a")

    for kind, name, attributes in tokens(page):
        if kind == "t":
            n = len(name.split())
            out.append((kind, name, stack[-1]))
            words[stack[-1]] += n
            if in_links:
                linked[stack[-1]] += n
            continue
        if kind == "<":
            if name in BLOCK and innermost("p") > blocks[-1]:
                pop(innermost("p"))
            if name in ENDS and innermost(*ENDS[name][0]) > innermost(*ENDS[name][1]):
                pop(innermost(*ENDS[name][0]))
            if name == "a" and places.get("a"):  # links do not nest
                pop(places["a"][-1]) if places["a"][-1] > blocks[-1] else None
            out.append((kind, name, stack[-1]))
            if name not in VOID and not attributes.endswith("/"):
                held = elements[stack[-1]]
                elements.append(Element(name, attributes, stack[-1], held.framed or held.name in FRAMES))
                for column in (words, linked, links):
                    column.append(0)
                places.setdefault(name, []).append(len(stack))
                if name in BLOCK and name != "p":
                    blocks.append(len(stack))
                stack.append(len(elements) - 1)
                in_links += name == "a"
        else:
            if places.get(name) and (name in BLOCK and name != "p" or places[name][-1] > blocks[-1]):
                pop(places[name][-1])
            out.append((kind, name, stack[-1]))
    pop(1)
    return Page(out, elements, words, linked, links)


def name_features(value: str, kind: str) -> list[tuple[str, float]]:
    """Features of a class or id, with their shares: the whole, and its parts, of which the last says most."""
    parts = [p.lower() for p in NAME_PART.findall(value)]
    if not parts:
        return []
    whole = "-".join(parts)
    return [(f"whole {whole}", 0.0), *((f"part {p}", 1.0 if p == parts[-1] else 0.7) for p in dict.fromkeys(parts))]


@cache
def described(name: str, attributes: str, framed: bool, wraps: bool = False) -> tuple[tuple[str, ...], tuple[tuple[tuple[str, float], ...], ...], bool]:
    """Of an element: the features of its tag and roles, those of each name it bears, and whether it shows no text.

    A form that ``wraps`` most of the page is there for technical reasons and none by its tag.
    """
    plain, names, out = [], [], name in NO_TEXT
    if name in CONTAINERS and not (wraps and name == "form"):
        plain.append(f"tag {name}{' inside' if framed and name == 'header' else ''}")
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += [tuple(f) for v in value.split() if (f := name_features(v, key))]
            elif key in ("role", "itemprop"):
                plain.append(f"{key} {value.strip().lower()}")
            else:
                out = out or key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(INVISIBLE.search(value)))
    return tuple(plain), tuple(dict.fromkeys(names)), out


def is_menu(page: Page, i: int) -> bool:
    """Whether most words of a container are links, and these are several."""
    return page.links[i] >= MANY_LINKS and page.linked[i] > 0.66 * page.words[i] and (page.elements[i].name in CONTAINERS or page.elements[i].name in ("ul", "ol", "table"))


class Weights(NamedTuple):
    features: dict[str, float]
    tags: dict[str, float]

    def own(self, name: str, attributes: str, framed: bool, wraps: bool = False) -> float:
        """Evidence of an element itself. A name known as a whole speaks for itself; of others their parts speak."""
        plain, names, out = described(name, attributes, framed, wraps)
        if out:
            return OUT
        get = self.features.get
        total = sum(get(f, 0.0) for f in plain)
        for whole, *parts in names:
            total += get(whole[0]) if whole[0] in self.features else sum(share * get(f, 0.0) for f, share in parts)
        return total

    def evidence(self, page: Page) -> list[float]:
        """Of each element for its words, the root's own first; elements come after their parents."""
        out: list[float] = []
        known: dict[tuple[str, str, bool, bool], float] = {}
        for i, (name, attributes, parent, framed) in enumerate(page.elements):
            key = (name, attributes, framed, 2 * page.words[i] > page.words[0])
            if key not in known:
                known[key] = self.own(*key)
            above, own = (out[parent] if parent >= 0 else BASE), known[key]
            if above == OUT or own == OUT:
                out.append(OUT)
                continue
            if is_menu(page, i):
                own += self.features.get("links", 0.0)
            out.append(max(LOW, min(HIGH, above + own)))
        return out


@cache
def weights() -> Weights:
    """Log odds of content for the features of elements, by the labelled elements, and for tags by the words on both their sides.

    An element counts for its words' kind, or for both kinds if each has a tenth of them. Tags score
    below zero: the odds only set how far.
    """
    seen: dict[str, list[float]] = {}
    tags: dict[str, list[float]] = {}
    for source in LABELLED:
        marked = re.sub(r"\[\[(\d+)\]\]", lambda m: "c " * int(m[1]), source)
        page = parsed(re.sub(r"\{(\d+)\}", lambda m: "o " * int(m[1]), marked))
        content = [0] * len(page.elements)
        kinds, at = [set(t.split()) for k, t, _ in page.tokens if k == "t" and t.split()], 0
        for k, t, i in page.tokens:
            if k == "t":
                content[i] += t.count("c")
                at += bool(t.split())
            else:
                inside = 0 < at < len(kinds) and "c" in kinds[at - 1] and "c" in kinds[at]
                tags.setdefault(t, [0.5, 0.5])[inside] += 1
        for i in range(len(page.elements) - 1, 0, -1):
            content[page.elements[i].parent] += content[i]
        for i, (name, attributes, _, framed) in enumerate(page.elements):
            if i and page.words[i]:
                share = content[i] / page.words[i]
                plain, names, _ = described(name, attributes, framed, 2 * page.words[i] > page.words[0])
                found = {*plain, *(f for parts in names for f, _ in parts), *(["links"] if is_menu(page, i) else [])}
                for f in found:
                    odds = seen.setdefault(f, [0.5, 0.5])
                    odds[0] += share < 0.9
                    odds[1] += share > 0.1
    return Weights({f: math.log(c / o) for f, (o, c) in seen.items()}, {n: -0.02 - 0.3 / (1 + c / o) for n, (o, c) in tags.items()})


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; the earliest and then the longest among equals."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and found[0] == start and total > 0):
            best, found = total, (start, i + 1)
    return found


def main_text(source: str) -> str:
    """The page's article text: blocks joined by two line breaks."""
    by, page = weights(), parsed(source)
    evidence = by.evidence(page)
    inside = [e.framed or e.name in FRAMES for e in page.elements]
    lengths = [len(t.split()) if k == "t" else 0 for k, t, _ in page.tokens]
    good = [0, 0]
    for (_, _, i), n in zip(page.tokens, lengths):
        good[inside[i]] += n if evidence[i] > 0 else 0
    if good[1] > FRAME_SHARE * sum(good):  # the page has an article, and other words lie beside it
        evidence = [e if f else max(OUT, e - BESIDE) for e, f in zip(evidence, inside)]
    scores = []
    for (k, t, i), n in zip(page.tokens, lengths):
        if evidence[i] <= 0 and inside[i]:  # what stays out of an article does not part it
            scores.append(0.0)
        elif k != "t":
            scores.append(by.tags.get(t, -0.2))
        else:
            scores.append(n * (1 + min(1.0, evidence[i])) if evidence[i] > 0 else -0.05 * n)
    start, end = best_region(scores)
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()

    for k, t, i in page.tokens[start:end]:
        if k == "t":
            if evidence[i] > 0:
                parts.append(t)
            elif t[:1].isspace() or t[-1:].isspace():
                parts.append(" ")
        elif t in BLOCK:
            close()
        elif t in SPACED:
            parts.append(" ")
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``_text``, the main text of ``html_col`` (replacing a column of that name)."""
    rows = pages.drop("_text")
    at = rows.columns.index(html_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(t.as_py() or "") for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "_text"])

    return rows.mapInArrow(run, schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))
