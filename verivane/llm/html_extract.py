"""Main-text extraction from HTML: blocks, two passes of rules.

A page is cut into blocks at block-level tags. Blocks inside menus, footers, sidebars, forms and the like, by tag, role or a word of
the class or id, are boilerplate, but for a wrapper that holds the page's prose: if most of the page's long, unlinked text
and its heading or `main` are inside, the name says nothing about it, nor do names like `with-sidebar`; nor does it about an `article` with most of the
prose, on a page where nothing else is marked as one. An `article` or `main`
element, or the text outside all of them, is the body if it holds most of the prose; the other side is not.

Pass one judges each remaining block alone: linked blocks are bad; long ones with many stop words good, with some near good, with
few weak; short ones ambiguous, as are near and weak ones. Pass two gives each ambiguous block the label of its nearest decided
neighbour, of its own section if one is decided there. Weak ones stay beside good ones alone of their section, or in the body's element. Ties go by what the
block is: near good is kept, a heading goes with what follows, a short block with the good one inside the body's element only. Where nothing
on a page (or in the body's element) is good, all ambiguous blocks stay.

On a page where no block has a share of STOP_LOW stop words, the language is none of theirs and long blocks are near good.

Null or empty html gives an empty text. Broken markup is read as browsers do: an attribute's quote that is never closed takes the
rest of the page; unclosed elements end with the page, those that are skipped (but for raw text) before the next block-level
tag. Repeated rows give equal texts. Work per page is linear in its length; nothing is cut. An empty table gives no rows.
Of clashing columns, the table's own `text` and `n_chars` are replaced; all others are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import small, table

#: Common function words of the languages that pages come in; fixed values.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his how i if in is it its more no not of on or our she so that the their them then there they this to was we were what when which who will with you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas pour plus qu que qui sa se ses son sur un une vous "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur "
    "al como con cuando de del desde donde el ella en entre es esta este fue ha la las lo los más me mi no nos o para pero por que se ser si sin sobre su sus también un una y ya".split()
)

RAW = "script|style|textarea|title"  #: skipped up to their end tag
SKIPPED = frozenset("noscript template iframe svg math object canvas audio video select button".split())
FOREIGN = frozenset("svg math".split())  #: may be closed in their own tag
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_SKIPPED = BLOCK - {"option"}
SECTIONS = frozenset("article aside body details dialog div fieldset footer form header main menu nav section".split())
HOLDS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td th tr ul".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what isn't the article; fixed values.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar aside widget widgets related recommended recommendations "
    "comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register share sharing social toolbar pagination pager form search copyright legal disclaimer".split()
)
TOP_NAMES = frozenset("header masthead topbar head".split())  #: against a block, but not inside an article
GOOD_NAMES = frozenset("article post entry story".split())

LONG, MEDIUM = 200, 70  #: characters
LINKS, STOP_HIGH, STOP_LOW = 0.33, 0.30, 0.15
FAR = 1 << 32  #: steps to a neighbour in another section: only where no other is decided

_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+(?:>|\Z)"""  #: of a tag, after its name
_UNREAD = rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{RAW})(?=[\s/>]){_REST}.*?(?:</(?P=raw)\s*+>|\Z)"
_TOKEN = re.compile(rf"{_UNREAD}|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<rest>{_REST})|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_SKIPPED_TAG = re.compile(rf"{_UNREAD}|<(?P<close>/?)(?P<tag>{'|'.join(sorted(SKIPPED))})(?=[\s/>])(?P<rest>{_REST})", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_EDGE = ".,;:!?\"'()[]«»“”…"


#: Before or after a name in a class, they say that something is nearby or absent; fixed values.
MODIFIERS = frozenset("with has have no without hide hides js is can supports".split())
AGAINST, HEADER, FOR, SAYS_NOTHING = "against", "header", "for", ""


def role(tag: str, rest: str) -> str:
    """What an element's tag and attributes say about what is inside."""
    names, hidden = set(), False
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.split():
                    words = [x.lower() for x in _NAME.findall(name)]
                    if not MODIFIERS.intersection(words):
                        names.update(words)
            elif key == "role":
                if value.lower() in BAD_ROLES:
                    return AGAINST
                if value.lower() in ("main", "article"):
                    return FOR
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= key == "hidden" or value.lower() == "true"
    if tag in BAD_TAGS or hidden or names & BAD_NAMES:
        return AGAINST
    if tag == "header" or names & TOP_NAMES:
        return HEADER
    return FOR if tag in ("article", "main") or names & GOOD_NAMES else SAYS_NOTHING


class Element:
    def __init__(self, tag: str, parent: Element | None, says: str = SAYS_NOTHING):
        self.tag, self.parent, self.says = tag, parent, says
        self.section = self if parent is None or tag in SECTIONS else parent.section
        self.prose = self.chars = 0  # inside
        self.titled = False  # holds a first-level heading or main


class Block:
    def __init__(self, text: str, links: float, heading: bool, element: Element):
        """links: share of linked characters."""
        self.text, self.links, self.heading, self.element = text, links, heading, element
        self.density = stop_density(text)
        self.prose = len(text) if len(text) >= MEDIUM and links <= LINKS else 0


def skips(page: str) -> dict[int, int]:
    """Where each skipped element that is closed starts, and where it ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _SKIPPED_TAG.finditer(page):
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if not m["close"]:
            if tag in FOREIGN and m["rest"].endswith("/>"):
                ends[m.start()] = m.end()
            else:
                opened.setdefault(tag, []).append(m.start())
        elif opened.get(tag):
            ends[opened[tag].pop()] = m.end()
    return ends


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks in order, and elements that hold some, outer ones first."""
    out: list[Block] = []
    root = inside = Element("", None)
    elements = [root]
    opened: Counter[str] = Counter()  # tags of the elements that `inside` is in, itself included
    in_link, heading, at = False, "", 0
    ends, unclosed = skips(page), False
    words: list[str] = []
    linked: list[str] = []

    def end() -> None:
        nonlocal words, linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                link = " ".join(html.unescape("".join(linked)).split()) if linked else ""
                out.append(Block(text, len(link) / len(text), bool(heading), inside))
                if heading == "h1":
                    inside.titled = True
            words, linked = [], []

    def read(start: int, stop: int) -> None:
        if stop > start and not unclosed:
            words.append(page[start:stop])
            if in_link:
                linked.append(words[-1])

    while m := _TOKEN.search(page, at):
        read(at, m.start())
        at = m.end()
        if not m["tag"]:
            continue
        tag, closing = m["tag"].lower(), m["close"]
        if unclosed and tag in ENDS_SKIPPED:
            unclosed = False
        if tag in SKIPPED and not closing:
            at = ends.get(m.start(), at)
            unclosed |= m.start() not in ends
        elif unclosed:
            continue
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            words.append(" ")
        elif tag in BLOCK:
            end()
            in_link = False
            heading = tag if not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else ""
            if tag in HOLDS:
                if not closing:
                    inside = Element(tag, inside, role(tag, m["rest"]))
                    inside.titled = tag == "main"
                    elements.append(inside)
                    opened[tag] += 1
                elif opened[tag]:  # what is climbed past is closed, so that no element is climbed twice
                    closed = ""
                    while closed != tag:
                        closed, inside = inside.tag, inside.parent
                        opened[closed] -= 1
    read(at, len(page))
    end()
    for b in out:
        b.element.prose += b.prose
        b.element.chars += len(b.text)
    for e in reversed(elements[1:]):
        e.parent.prose += e.prose
        e.parent.chars += e.chars
        e.parent.titled |= e.titled
    return out, elements


def stop_density(text: str) -> float:
    tokens = text.lower().split()
    return sum(t in STOP_WORDS or t.strip(_EDGE) in STOP_WORDS for t in tokens) / len(tokens)


def body_of(found: list[Block], elements: list[Element]) -> tuple[Element | None, set[int]]:
    """The marked element that is the page's body, if one is; ids of the elements whose blocks are boilerplate."""
    bad: set[int] = set()
    mark: dict[int, Element | None] = {}  # the outermost marked element that each is in
    page = elements[0]
    # An article that is named for its subject or its place is the page's own if it has most of the prose and none is named otherwise.
    named = any(e.says == FOR and e.prose for e in elements)
    for e in elements:
        above = mark.get(id(e.parent)) if e.parent else None
        # A wrapper of the page's prose and its heading is not what its name says.
        wrapper = 2 * e.prose > page.prose and (e.titled or e.tag in ("div", "section", "form") and e.prose > max(4 * LONG, 0.9 * page.prose) or e.tag == "article" and not named)
        says = (FOR if e.tag == "article" else SAYS_NOTHING) if e.says == AGAINST and wrapper else e.says
        if e.parent and id(e.parent) in bad or says == AGAINST or says == HEADER and above is None and not wrapper:
            bad.add(id(e))
        mark[id(e)] = above or (e if says == FOR and id(e) not in bad else None)
    marked: dict[int, list[int]] = {}  # prose and characters of each, 0 for what is outside
    for b in found:
        if id(b.element) not in bad:
            m = mark[id(b.element)]
            sums = marked.setdefault(id(m) if m else 0, [0, 0])
            sums[0] += b.prose
            sums[1] += len(b.text)
    total = sum(p for p, _ in marked.values())
    outside = marked.pop(0, [0, 0])
    body = None
    if marked:
        best = max(marked, key=lambda k: marked[k])
        if 2 * marked[best][0] >= total:
            body = next(m for m in mark.values() if m is not None and id(m) == best)
            bad.update(k for k, m in mark.items() if m is not body)
        elif 2 * outside[0] >= total:
            bad.update(k for k, m in mark.items() if m is not None)
    return body, bad


def first_pass(b: Block, bad: bool, body: bool, known: bool) -> str:
    """good, bad, short, near or weak. body: whether in the body's element; known: whether in a language whose stop words are known."""
    if bad:
        return "bad"
    if b.links > LINKS and (not body or b.links > 0.8 and len(b.text) < MEDIUM):
        return "bad"
    if b.heading:
        return "short"
    if len(b.text) < MEDIUM:
        return "bad" if b.links > 0 and not body else "short"
    if b.links > LINKS:
        return "weak"
    if b.density >= STOP_HIGH or b.density >= STOP_LOW and body:
        return "good" if len(b.text) >= LONG or body else "near"
    return "near" if b.density >= STOP_LOW or not known else "weak"


def second_pass(found: list[Block], labels: list[str], body: list[bool]) -> list[bool]:
    """Whether each block is kept."""

    def nearest(order) -> list[tuple[float, str]]:
        """Of each block the decided one that comes last before it in this order, of its own section if there is one: how far it is, and its label."""
        out: list[tuple[float, str]] = [(math.inf, "")] * len(found)
        last: dict[int, int] = {}  # by section, and of all under 0
        for i in order:
            section = id(found[i].element.section)
            if section in last:
                out[i] = (abs(i - last[section]), labels[last[section]])
            elif 0 in last:
                out[i] = (FAR + abs(i - last[0]), labels[last[0]])
            if labels[i] in ("good", "bad"):
                last[section] = last[0] = i
        return out

    before, after = nearest(range(len(found))), nearest(range(len(found) - 1, -1, -1))
    good = {b for label, b in zip(labels, body) if label == "good"}
    keep = []
    for i, label in enumerate(labels):
        (x, left), (y, right) = before[i], after[i]
        if label in ("good", "bad"):
            keep.append(label == "good")
        elif body[i] not in good and (body[i] or not good):
            keep.append(True)
        elif label == "weak" and not body[i]:
            keep.append({at for steps, at in (before[i], after[i]) if steps < FAR} == {"good"})
        elif left == right or x != y:
            keep.append((left if x < y else right) == "good" or label == "near" and "good" in (left, right))
        elif found[i].heading:
            keep.append(right == "good")
        else:
            keep.append(label == "near" or body[i] and label == "short")
    return keep


def main_text(page: str | None) -> str:
    found, elements = blocks(page or "")
    body, bad = body_of(found, elements)
    off = [id(b.element) in bad for b in found]
    inside = [body is not None and not x for x in off]
    known = any(not x and b.prose and b.density >= STOP_LOW for x, b in zip(off, found))
    labels = [first_pass(b, x, y, known) for b, x, y in zip(found, off, inside)]
    return " ".join(b.text for b, kept in zip(found, second_pass(found, labels, inside)) if kept)


def extract(pages: DataFrame, content: str = "html") -> DataFrame:
    """All other columns, text and n_chars (code points) in place of the html."""
    keep = [c for c in pages.columns if c not in (content, "text", "n_chars")]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep) + "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            text = pa.array([main_text(x) for x in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.record_batch([*b.columns[:-1], text], names=[*keep, "text"])

    return pages.select(*keep, content).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE_SQL: dict[str, str] = {}  # rules over nested markup: tests have pages with known texts
