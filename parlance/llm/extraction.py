"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into text blocks at every tag that is not inline.  A block has its word
count and link density (share of its words inside links), those of the blocks before
and after it, whether it is a heading, and what its surroundings say: 1 inside an
element that names an article, -1 inside one that names menus, notices, adverts,
comments and the like, by tag, role or class and id words.  The inner of the two counts.  An
element that names both is 0 unless it is inside a -1, so words and links decide; names
that only say what a page has or lacks (no-sidebar, with-comments, share-enabled) say
nothing of their element.  Inside an article a name says -1 only if all its words do
(comment-list, share-buttons, but not social-history), and an <address> says nothing.  A
<header> is -1 unless it is inside an article.
The links of a paragraph inside an article count as its words.
A small decision tree over these features, grown on ``LABELLED`` (example blocks with
their label), keeps or drops the block.  Of a page of which the tree keeps
nothing the blocks stay that are in no -1 place and not mostly links, so a short page is its own text.  Scripts, styles, form controls, embedded media, heads and
comments are no text at all.  Only scripts, styles and heads are skipped to an end tag
wherever it stands; the others end with their parents, and those without an end tag of
their own also where the next element of the page's structure begins.

Character references are decoded, white space inside a block becomes one space, and kept
blocks are joined by one space.  Pages are one row each, so a page is handled by one
task; nothing is cut or capped.

Defined results: null and empty html give an empty text; html without tags is one block;
a tag cut off by the end of the page ends the text before it; unknown and unclosed
elements are closed with their parents; repeated rows and null ids give rows like any
other; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: element names of HTML by their part in a page
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style head".split())
#: Elements whose contents are no text; those of the first group are skipped if they are closed.
SKIPPED = frozenset("noscript template textarea title iframe".split())
HIDDEN = SKIPPED | frozenset("select option button svg math object canvas audio video datalist".split())
#: Hidden elements that do not end the text block around them.
WITHIN = frozenset("script style template svg math".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset address".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
MAIN_WORDS = frozenset("article post entry story content main body text".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs sidebar side "
    "footer header masthead comment comments reply replies disqus respond cookie cookies consent notice notices alert gdpr privacy newsletter subscribe subscription signup login "
    "share sharing social related recommended popular trending widget toolbar pagination pager tags copyright legal disclaimer popup modal overlay skip search form".split()
)
#: Words of a name that say the page has or lacks what the words behind or in front of them name.
MODIFIERS = frozenset("no non not without with has have hide show".split())
STATES = frozenset("enabled disabled open closed".split())
#: Words that say nothing of their own beside others.
GENERIC = frozenset("a area bar block body bottom box btn button buttons col column container content group icon icons id inner item items left link links list main nav outer panel post posts right row section site slot top unit ul wrap wrapper x".split())
#: What an element says that names both an article and other things.
DOUBT = 2
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
# a slash that belongs to the tag, not to an unquoted value
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])[^\s"'=]*/\s*\Z""")
_SPACE = re.compile(r"\s+")
_P_OR_INLINE = INLINE | {"p"}
_CLOSES_P = frozenset("p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 hr pre blockquote figure address fieldset".split())
_STRUCTURE = _CLOSES_P | frozenset("body li dt dd tr td th tbody thead caption figcaption details summary".split())

#: Example blocks: words, link density, words and link density of the block before, the same of the block after,
#: surroundings, heading; and whether the block is main text.  Written by hand for this tree.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading")
LABELLED = (
    # inside an article: text of any length, headings, short paragraphs, captions
    ((120, 0.0, 60, 0.0, 80, 0.0, 1, 0), 1), ((45, 0.05, 120, 0.0, 60, 0.0, 1, 0), 1), ((8, 0.0, 4, 1.0, 90, 0.0, 1, 1), 1),
    ((1, 0.0, 30, 0.0, 25, 0.0, 1, 0), 1), ((2, 0.0, 12, 0.0, 0, 0.0, 1, 0), 1), ((300, 0.02, 9, 0.0, 0, 0.0, 1, 0), 1),
    ((15, 0.3, 70, 0.0, 70, 0.0, 1, 0), 1), ((5, 0.0, 14, 0.0, 5, 0.0, 1, 1), 1), ((3, 0.0, 3, 0.0, 3, 0.0, 1, 0), 1),
    ((20, 0.4, 50, 0.0, 12, 1.0, 1, 0), 1), ((900, 0.0, 5, 0.0, 11, 0.3, 1, 0), 1), ((6, 0.0, 200, 0.0, 8, 0.0, 1, 0), 1),
    # inside an article, but nothing but links
    ((4, 1.0, 60, 0.0, 4, 1.0, 1, 0), 0), ((7, 1.0, 5, 1.0, 3, 1.0, 1, 0), 0), ((2, 1.0, 2, 1.0, 40, 0.0, 1, 0), 0), ((3, 0.9, 30, 0.0, 3, 1.0, 1, 0), 0),
    # menus, footers, notices, adverts, comments: whatever their length
    ((1, 1.0, 1, 1.0, 1, 1.0, -1, 0), 0), ((3, 1.0, 0, 0.0, 2, 1.0, -1, 0), 0), ((12, 0.0, 5, 1.0, 9, 0.0, -1, 0), 0),
    ((40, 0.0, 4, 1.0, 80, 0.0, -1, 0), 0), ((9, 0.1, 70, 0.0, 0, 0.0, -1, 0), 0), ((85, 0.0, 3, 0.0, 60, 0.0, -1, 0), 0),
    ((150, 0.01, 4, 0.0, 40, 0.0, -1, 0), 0), ((2, 0.0, 90, 0.0, 10, 0.0, -1, 1), 0), ((25, 0.0, 20, 0.0, 30, 0.0, -1, 0), 0),
    ((6, 0.0, 1, 1.0, 6, 0.0, -1, 1), 0), ((60, 0.2, 12, 0.0, 0, 0.0, -1, 0), 0), ((400, 0.0, 2, 0.0, 2, 0.0, -1, 0), 0),
    # no word of where: long or between long, with few links, is text
    ((60, 0.0, 40, 0.0, 50, 0.0, 0, 0), 1), ((35, 0.05, 4, 1.0, 60, 0.0, 0, 0), 1), ((90, 0.1, 0, 0.0, 0, 0.0, 0, 0), 1),
    ((22, 0.0, 45, 0.0, 6, 0.5, 0, 0), 1), ((14, 0.0, 55, 0.0, 48, 0.0, 0, 0), 1), ((7, 0.0, 40, 0.0, 66, 0.0, 0, 0), 1),
    ((6, 0.0, 3, 1.0, 80, 0.0, 0, 1), 1), ((9, 0.0, 60, 0.0, 70, 0.0, 0, 1), 1), ((250, 0.0, 1, 1.0, 2, 1.0, 0, 0), 1),
    ((18, 0.1, 30, 0.0, 0, 0.0, 0, 0), 1), ((3, 0.0, 38, 0.0, 30, 0.0, 0, 0), 1), ((28, 0.0, 2, 1.0, 3, 1.0, 0, 0), 1),
    # no word of where: short among short, or mostly links, is not
    ((2, 0.0, 1, 1.0, 3, 1.0, 0, 0), 0), ((4, 0.0, 3, 1.0, 2, 1.0, 0, 1), 0), ((5, 0.0, 0, 0.0, 4, 1.0, 0, 0), 0),
    ((6, 0.0, 5, 0.0, 3, 0.0, 0, 0), 0), ((30, 0.9, 40, 0.0, 20, 0.0, 0, 0), 0), ((12, 0.6, 30, 0.0, 5, 1.0, 0, 0), 0),
    ((8, 0.0, 3, 0.0, 0, 0.0, 0, 0), 0), ((1, 1.0, 40, 0.0, 1, 1.0, 0, 0), 0), ((70, 0.8, 10, 0.9, 9, 1.0, 0, 0), 0),
    ((2, 0.0, 60, 0.0, 0, 0.0, 0, 0), 0), ((3, 0.0, 90, 0.0, 0, 0.0, 0, 0), 0), ((4, 0.0, 45, 0.0, 0, 0.0, 0, 0), 0),
    ((4, 0.0, 4, 0.0, 5, 0.0, 0, 0), 0), ((9, 0.0, 2, 1.0, 6, 0.4, 0, 0), 0), ((3, 0.5, 60, 0.0, 2, 1.0, 0, 0), 0),
)


def grow_tree(rows: np.ndarray, labels: np.ndarray, least: int = 1):
    """A binary tree by Gini impurity: a label, or (feature, limit, tree up to the limit, tree beyond)."""
    if len(set(labels.tolist())) < 2 or len(rows) <= least:
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in ((values[1:] + values[:-1]) / 2).tolist():
            low = rows[:, f] <= limit
            gini = sum(part.sum() * (1 - p**2 - (1 - p) ** 2) for part in (low, ~low) for p in (labels[part].mean(),))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, limit
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, limit = best
    low = rows[:, f] <= limit
    return f, limit, grow_tree(rows[low], labels[low], least), grow_tree(rows[~low], labels[~low], least)


def classify(tree, row: tuple) -> int:
    while not isinstance(tree, int):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


@cache
def default_tree():
    return grow_tree(np.asarray([r for r, _ in LABELLED], float), np.asarray([y for _, y in LABELLED]))


def _words(name: str) -> set[str]:
    """The words of one class or id that name the element itself."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
    return set() if words and words[-1] in STATES else set(words)


def _names(name: str) -> bool:
    """Whether one class or id names boilerplate and nothing else."""
    words = _words(name)
    return bool(words & BOILER_WORDS) and words <= BOILER_WORDS | GENERIC


def _place(tag: str, attributes: str, inside: bool = False) -> int:
    """What an element says of its text: 1 main, -1 not, 0 nothing, DOUBT both.  ``inside``: it is in an article."""
    if tag in MAIN_TAGS:
        return 1
    if tag in BOILER_TAGS and not (inside and tag == "address"):
        return -1
    if not attributes or tag in ("body", "html"):
        return 0
    main = boiler = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            main, boiler = main or value in MAIN_TAGS, boiler or value in BOILER_ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return -1
        elif name in ("class", "id"):
            words = set().union(*map(_words, value.split())) - {tag}
            main = main or bool(words & MAIN_WORDS)
            boiler = boiler or (any(map(_names, value.split())) and bool(words) if inside else bool(words & BOILER_WORDS))
    return DOUBT if main and boiler else main - boiler


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where the elements of one name that are closed begin, and where their end tags end."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)|([^>]*))>", page, re.I):
        if not m[1]:
            if not _SELF_CLOSED.search(m[2] if m[2] is not None else m[3]):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, place, heading) of every text block, in page order.

    What is asked of the open elements is kept beside the stack, so a page takes time in proportion to its length however deep it is."""
    out: list[tuple[str, int, int, int, int]] = []
    text: list[tuple[str, bool]] = []
    # name, place of what is in it (its own or that around it), and of hidden elements whether they are closed (None: not hidden)
    stack: list[tuple[str, int, bool | None]] = []
    at_tag: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    hidden_at: list[int] = []
    headings = mains = 0
    closed: dict[str, dict[int, int]] = {}
    links = 0

    def place() -> int:
        return stack[-1][1] if stack else 0

    def add(tag: str, where: int, kind: bool | None) -> None:
        nonlocal headings, mains
        headings += tag in HEADINGS
        mains += tag in MAIN_TAGS
        at_tag.setdefault(tag, []).append(len(stack))
        if kind is not None:
            hidden_at.append(len(stack))
        stack.append((tag, where, kind))

    def push(tag: str, attributes: str) -> None:
        """Opens an element whose text is shown."""
        around = place()
        own = _place(tag, attributes, mains > 0 and around == 1)
        if tag == "header" and around != 1 and not mains:
            own = -1
        add(tag, min(around, 0) if own == DOUBT else own or around, None)

    def pop() -> str:
        nonlocal headings, mains
        tag, _, kind = stack.pop()
        headings -= tag in HEADINGS
        mains -= tag in MAIN_TAGS
        at_tag[tag].pop()
        if kind is not None:
            hidden_at.pop()
        return tag

    def last(tag: str) -> int:
        """Where the innermost open element of a name is, or -1."""
        return at_tag[tag][-1] if at_tag.get(tag) else -1

    def end() -> None:
        if text:
            whole = _SPACE.sub(" ", "".join(t for t, _ in text)).strip()
            if whole:
                n = len(whole.split(" "))
                linked = min(n, len(" ".join(t for t, in_link in text if in_link).split()))
                if place() == 1 and last("p") >= 0:
                    linked = 0
                out.append((whole, n, linked, place(), int(headings > 0)))
            text.clear()

    def say(raw: str) -> None:
        if raw and not hidden_at:
            text.append((html_lib.unescape(raw), links > 0))

    at, n = 0, len(page)
    for m in iter(lambda: _TOKEN.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not m[0].endswith(">"):
            break  # cut off
        closing = bool(m[1] or m[4])
        attributes = m[3] if m[2] else m[6]
        if tag in RAW and not closing:
            if tag != "head" and _SELF_CLOSED.search(attributes):
                continue
            # ends at its own end tag; an unclosed head ends where the body begins
            ends = re.compile(rf"</{tag}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, at)
            if tag != "head" or ends:
                at = ends.end() if ends else n
            if tag not in WITHIN and not hidden_at:
                end()
            continue
        if tag in HIDDEN and not closing:
            if tag not in WITHIN and not hidden_at:
                end()
            if not _SELF_CLOSED.search(attributes):
                if tag not in closed:
                    closed[tag] = _closed(page, tag)
                ends_at = closed[tag].get(m.start())
                if ends_at and tag in SKIPPED:
                    at = ends_at
                else:
                    add(tag, place(), ends_at is not None)
            continue
        if hidden_at:
            first = hidden_at[0]
            if closing:
                own = last(tag)
                if own >= first:
                    while len(stack) > own:
                        pop()
                    continue
                # the end of an element around the hidden one, which inline elements without attributes do not show
                if own < 0 and (tag not in INLINE or stack[first][2]):
                    continue
                if tag in INLINE and stack[first][2]:
                    continue
            elif stack[first][2] or tag not in _STRUCTURE | MAIN_TAGS:
                if tag not in VOID and not _SELF_CLOSED.search(attributes):
                    add(tag, place(), None)
                continue
            if tag not in INLINE:
                end()
            while len(stack) > first:
                pop()
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            elif not closing and attributes and tag not in VOID:
                push(tag, attributes)
            elif closing and stack and stack[-1][0] == tag:
                pop()
            continue
        end()
        links = 0
        if tag in VOID:
            continue
        if closing:
            if last(tag) >= 0:
                while pop() != tag:
                    pass
        else:
            if tag in _CLOSES_P and last("p") >= 0:
                while stack and stack[-1][0] in _P_OR_INLINE:
                    if pop() == "p":
                        break
            push(tag, attributes)
    else:
        say(page[at:])
    end()
    return out


def main_text(page: str | None, tree=None) -> str:
    """The kept blocks of one page, joined by one space."""
    found = blocks(page or "")
    tree = default_tree() if tree is None else tree
    size = [(b[1], b[2] / b[1]) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    kept = [b for i, b in enumerate(found) if classify(tree, (*size[i], *around[i], *around[i + 2], *b[3:]))]
    return " ".join(b[0] for b in kept or [b for b in found if b[3] >= 0 and 2 * b[2] < b[1]])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
