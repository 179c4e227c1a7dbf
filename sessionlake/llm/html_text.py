"""Operator 9: the main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone:
links over much of it make it bad; long blocks are good or bad by the share of common
function words in them; the rest stays ambiguous. The function words are English, French, German and
Spanish; in a page whose text hardly has any, length and links alone decide. In the second pass an ambiguous block
takes the label of the nearest decided block, and of the better one if two are as near.
What a page marks as menu, header, footer, sidebar, notice, advert, form or comments is
bad whatever it says; in a page with an ``article`` or ``main`` element, what lies outside is
bad, and a lack of function words inside it (tables, code) leaves a block ambiguous.

Defined results: null, empty and markup-only pages give an empty text. Markup that is cut
off or wrongly nested is read as far as it goes. Pages are independent, so repeated rows and
null ids come out as they came in; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Common function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to in a is that it for on was be with as this by are from an at or not have has but they you he she we
    de la le et les des en un une du dans qui que par pour sur au est pas plus ne se ce il elle son sa
    der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    el y los del las por con no su para al lo como más o pero sus le ha me si sin este""".split()
)

# Element names of HTML.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr
    ul title head""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog head title button select textarea fieldset label".split())
MAIN_TAGS = frozenset(["article", "main"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
# Words of class names and ids. A name marks what is not the article if all of its words are
# of these lists and one is of the first two: "site-footer" does, "has-sidebar" and "related-posts-off" don't.
READER_WORDS = frozenset("comment comments disqus reply replies respond cookie cookies consent ad ads advert adverts advertisement".split())
LAYOUT_WORDS = frozenset(
    """nav navbar navigation menu sidebar footer header masthead banner sponsor sponsored promo notice popup modal overlay share sharing
    social related recommended recommendations newsletter subscribe subscription breadcrumb breadcrumbs login signup signin search widget
    widgets toolbar pagination pager copyright skiplink""".split()
)
NEUTRAL_WORDS = frozenset(
    """site page side main top bottom left right global primary secondary first last post posts article articles content list item items
    link links box bar area block section wrapper wrap container inner outer button buttons form field thread skip user reader message
    messages column col row group panel unit slot""".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|object|canvas|audio|video|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"\w+")

#: Rules of the first pass.
MAX_LINK_SHARE = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
LOW_STOP_SHARE = 0.10
HIGH_STOP_SHARE = 0.20
#: A page is in another language if less of its text than this is in blocks with function words.
KNOWN_SHARE = 0.1


@dataclass
class Block:
    text: str
    links: int
    marked_bad: bool
    in_main: bool
    marks: tuple[int, ...] = ()  # elements around it that are marked by a layout word


#: What an element says of itself: it is no part of the article, or its name is one of layout.
SURE, LAYOUT = "sure", "layout"


def named(value: str) -> str | None:
    """What the names of an element say."""
    found = None
    for name in value.split():
        parts = [x for x in re.split(r"[_-]+|\d+", name) if x]
        if all(x in READER_WORDS or x in LAYOUT_WORDS or x in NEUTRAL_WORDS for x in parts):
            if any(x in READER_WORDS for x in parts):
                return SURE
            if any(x in LAYOUT_WORDS for x in parts):
                found = LAYOUT
    return found


def marked(tag: str, attrs: str, in_main: bool) -> str | None:
    """Whether an element says of itself that it is no part of the article."""
    if tag in BAD_TAGS or tag == "header" and not in_main:
        return SURE
    found = None
    for name, a, b, c in ATTRIBUTE.findall(attrs or ""):
        name, value = name.lower(), (a or b or c).strip().lower()
        if name == "role" and value in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if name in ("class", "id") and tag not in ("html", "body", "main") and (says := named(value)):
            if says == SURE and (tag != "article" or in_main):
                return SURE
            if tag != "article":
                found = LAYOUT
    return found


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; white space and character references are resolved."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # name, surely bad here or above, in main, layout marks
    standing: Counter[str] = Counter()  # names in the stack
    marks: tuple[int, ...] = ()
    elements = 0
    text: list[str] = []
    links = depth_a = breaks = 0
    bad = main = False

    def close() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, links, bad, main, marks))
            text.clear()
        links = 0

    def say(s: str) -> None:
        nonlocal links, breaks
        if s:
            text.append(s)
            if depth_a:
                links += len(s.strip())
            if not s.isspace():
                breaks = 0

    pos = 0
    for m in TOKEN.finditer(page):
        say(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                say(" ")
            continue
        tag, ending, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            breaks += 1
            say(" ")
            if breaks >= 2:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
            depth_a = 0
        if tag in VOID_TAGS:
            continue
        if ending:
            if tag == "a":
                depth_a = 0
            if standing[tag]:
                now = (bad, main, marks)
                while (name := stack.pop()[0]) != tag:
                    standing[name] -= 1
                standing[tag] -= 1
                after = stack[-1][1:] if stack else (False, False, ())
                if now != after:
                    close()
                bad, main, marks = after
        else:
            if tag == "a":
                depth_a = 1
            if tag == "p" and stack and stack[-1][0] == "p":
                standing[stack.pop()[0]] -= 1
            says, enters = marked(tag, attrs, main), tag in MAIN_TAGS or 'role="main"' in attrs
            now_marks = () if enters and not main else marks  # a name around the article says nothing of it
            if says == LAYOUT:
                elements += 1
                now_marks = (*now_marks, elements)
            now = (bad or says == SURE, main or enters, now_marks)
            if now != (bad, main, marks):
                close()
                bad, main, marks = now
            if not attrs.endswith("/"):
                stack.append((tag, bad, main, marks))
                standing[tag] += 1
    say(page[pos:])
    close()
    # a layout name on what holds most of the page's text doesn't count
    size: Counter[int] = Counter()
    for b in out:
        if not b.marked_bad:
            size.update(dict.fromkeys(b.marks, len(b.text)))
    half = sum(len(b.text) for b in out if not b.marked_bad) / 2
    for b in out:
        b.marked_bad = b.marked_bad or any(size[m] <= half for m in b.marks)
    return out


def stop_share(block: Block) -> float:
    """The share of function words among the block's words."""
    words = WORD.findall(block.text.lower())
    return sum(w in FUNCTION_WORDS for w in words) / max(1, len(words))


def other_language(found: list[Block]) -> bool:
    """Hardly any of the text that could be an article is in blocks with function words."""
    size = known = 0
    for b in found:
        n = len(b.text)
        if not b.marked_bad and n >= SHORT_CHARS and b.links / n <= MAX_LINK_SHARE:
            size += n
            known += n * (stop_share(b) >= LOW_STOP_SHARE)
    return known < KNOWN_SHARE * size


def first_pass(block: Block, page_has_main: bool, other: bool = False) -> bool | None:
    """True: article, False: not, None: ambiguous; by length and links alone in an ``other`` language."""
    n = len(block.text)
    if block.marked_bad or page_has_main and not block.in_main:
        return False
    if block.links / n > MAX_LINK_SHARE:
        return False
    if n < SHORT_CHARS:
        return None
    if other:
        return True
    share = stop_share(block)
    if share >= HIGH_STOP_SHARE:
        return True if n >= LONG_CHARS or block.in_main else None
    if share >= LOW_STOP_SHARE or block.in_main:
        return None
    return False


def second_pass(labels: list[bool | None], blocks_: list[Block]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block that is not marked bad."""
    n = len(labels)
    decided = [None if b.marked_bad else x for x, b in zip(labels, blocks_, strict=True)]
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if decided[i] is not None:
                last = (i, decided[i])
            near[i] = last
    out = []
    for i, label in enumerate(labels):
        if label is None:
            sides = [(abs(x[0] - i), not x[1]) for x in (before[i], after[i]) if x and blocks_[x[0]].in_main == blocks_[i].in_main]
            label = not min(sides)[1] if sides else blocks_[i].in_main
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, one line for each block of the article."""
    if not page:
        return ""
    found = blocks(page)
    has_main = any(b.in_main and not b.marked_bad for b in found)
    other = not has_main and other_language(found)
    keep = second_pass([first_pass(b, has_main, other) for b in found], found)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page: key, url, its main text and the number of code points in it."""
    rows = pages.select(key, url, page)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return rows.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars bigint")
