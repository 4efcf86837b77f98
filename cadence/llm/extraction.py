"""Main text of web pages by two passes of block rules (operator 12)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadence.llm.text import pieces, utf8
from cadence.session import bound_arrow

EXTRACTED = "page_id long, url string, text string, n_chars long"
BLOCKS = "page_id long, block int, text string, length int, link_density double, stop_density double, first string, label string"

# Frequent function words of the languages that pages are written in.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its may more most my no not of on one only or other our out she should so some such than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über und uns vom von vor war was wie wir wird zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous",
    "es": "al como con de del el ella en entre era es esta este fue ha la las le lo los más me muy no o para pero por que se sin sobre son su sus también un una y ya",
}
# Names of elements, and words in class, id and role that mark what is not the article.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
HIDDEN_TAGS = frozenset("audio button canvas datalist label legend math noscript object optgroup option output select svg template video".split())
CLOSE_P = BLOCK_TAGS - frozenset("body caption head html tbody td tfoot th thead title tr".split())
WALLS = {"li": "ul ol menu dir", "dd": "dl", "dt": "dl", "tr": "table", "td": "table tr", "th": "table tr", "option": "select"}
OWN_KIND = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_TAGS = frozenset("article main".split())
SURE_TAGS = frozenset("aside dialog footer".split())
WEAK_TAGS = frozenset("form header menu nav".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
SURE_WORDS = COMMENT_WORDS | frozenset("ad ads advert advertisement advertisements advertising adverts alert alertdialog aside banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright dialog disclaimer footer gdpr modal newsletter notice notices notification overlay pager pagination paywall popular popup promo promoted promotion recommendations recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toc trending".split())
WEAK_WORDS = frozenset("form header login masthead menu nav navbar navigation search searchbox toolbar topbar widget widgets".split())

ATTRIBUTES = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s]+))?""")
OPEN_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
CLOSE_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
RAW_END = {name: re.compile(f"</{name}[\\s/>]", re.IGNORECASE) for name in RAW_TAGS}
LETTERS = re.compile(r"[^\W\d_]+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass: blocks under `short` characters are ambiguous, those of at least `long` with a stop-word
    density of `dense` are text, under `sparse` they are not; over `links` of its characters in links no block is."""

    short: int = 70
    long: int = 200
    sparse: float = 0.15
    dense: float = 0.30
    links: float = 0.4
    stop_words: tuple[str, ...] = tuple(sorted({w for words in STOP_WORDS.values() for w in words.split()}))


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    marked: str
    inside: bool
    stop_density: float = 0.0
    first: str = ""
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.linked / max(1, len(self.text))


def _marks(tag: str, attributes: str) -> tuple[str, bool]:
    """What an element's own name and attributes say: '', 'weak' or 'sure' (not the article), and whether it is hidden."""
    mark = "sure" if tag in SURE_TAGS else "weak" if tag in WEAK_TAGS else ""
    hidden = tag in HIDDEN_TAGS
    if not attributes:
        return mark, hidden
    for name, value in ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            hidden = True
        elif name in ("class", "id", "role") and tag not in ("html", "body"):
            for whole in value.split():
                parts = [p.lower() for p in NAME_PARTS.findall(whole)]
                if parts and parts[0] in ("has", "no", "with", "without"):
                    continue
                if tag in MAIN_TAGS:
                    mark = "sure" if COMMENT_WORDS & set(parts) else mark
                elif SURE_WORDS & set(parts):
                    mark = "sure"
                elif WEAK_WORDS & set(parts):
                    mark = mark or "weak"
    return mark, hidden


class _Open:
    """Open elements, each with what it inherits: mark, hidden, inside an article or main element, inside a link, and the
    block element that it is in."""

    ROOT = ("", "", False, False, False, "")

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool, bool, bool, str]] = []
        self.names: Counter[str] = Counter()
        self.top = self.ROOT

    def push(self, tag: str, attributes: str) -> None:
        mark, hidden = _marks(tag, attributes)
        _, above, unseen, inside, link, block = self.top
        if tag in MAIN_TAGS:
            # A header, menu or form that was never closed, or that holds the whole page, ends at the article.
            above, inside = ("" if above == "weak" else above), inside or above != "sure"
        if tag in HEADINGS and inside and above == "weak" and not mark:
            above = ""
        mark = "sure" if "sure" in (mark, above) else mark or above
        self.top = (tag, mark, unseen or hidden, inside, link or tag == "a", tag if tag in BLOCK_TAGS else block)
        self.stack.append(self.top)
        self.names[tag] += 1

    def pop_to(self, tag: str) -> None:
        while self.stack:
            name = self.stack.pop()[0]
            self.names[name] -= 1
            if name == tag:
                break
        self.top = self.stack[-1] if self.stack else self.ROOT

    def close(self, tag: str) -> None:
        if self.names[tag]:
            self.pop_to(tag)

    def implied(self, tag: str) -> None:
        """End tags that a start tag stands for: of an open paragraph, and of an item or cell of the same list or table."""
        if tag in CLOSE_P and self.names["p"]:
            for name, *_ in reversed(self.stack):
                if name == "p":
                    self.pop_to("p")
                    break
                if name in ("td", "th", "table", "caption", "button", "object"):
                    break
        if tag in OWN_KIND and any(self.names[k] for k in OWN_KIND[tag]):
            walls = WALLS[tag].split()
            for name, *_ in reversed(self.stack):
                if name in OWN_KIND[tag]:
                    self.pop_to(name)
                    break
                if name in walls:
                    break


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order: runs between the tags of block elements, white space as one space, without
    comments, scripts, styles and hidden elements. One pass over the page, whatever is left open or cut off."""
    out: list[Block] = []
    state, said, linked = _Open(), [], []
    tag_now, mark_now, inside_now = "", "", False
    at, n, quoted = 0, len(page), True

    def end() -> None:
        if said:
            text = " ".join("".join(said).split())
            if text:
                out.append(Block(text, len(" ".join("".join(linked).split())), tag_now, mark_now, inside_now))
            said.clear()
            linked.clear()

    def say(raw: str) -> None:
        nonlocal tag_now, mark_now, inside_now
        _, mark, hidden, inside, link, block = state.top
        if hidden:
            return
        text = unescape(raw) if "&" in raw else raw
        if not said:
            tag_now, mark_now, inside_now = block, mark, inside
        said.append(text)
        if link:
            linked.append(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        follow = page[lt + 1 : lt + 2]
        if follow == "/":
            m = CLOSE_TAG.match(page, lt)
            if m is None:
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
                continue
            tag, at = m[1].lower(), m.end()
            if tag in BLOCK_TAGS:
                end()
            elif tag == "br":
                say(" ")
            state.close(tag)
        elif follow.isascii() and follow.isalpha():
            m = OPEN_TAG.match(page, lt) if quoted else None
            if m is not None:
                tag, attributes, at = m[1].lower(), m[2], m.end()
            else:
                # A quote or tag that never ends: from here on tags end at the next >, so that no page is read twice.
                quoted, stop = False, page.find(">", lt)
                if stop < 0:
                    break
                name = re.match(r"[^\s/>]*", page[lt + 1 : stop])[0]
                tag, attributes, at = name.lower(), page[lt + 1 + len(name) : stop], stop + 1
            if tag in RAW_TAGS:
                close = RAW_END[tag].search(page, at)
                at = n if close is None else (page.find(">", close.start()) + 1 or n)
                if tag in BLOCK_TAGS:
                    end()
                continue
            if tag in BLOCK_TAGS:
                end()
                state.implied(tag)
            elif tag == "option":
                state.implied(tag)
            elif tag in ("br", "img"):
                say(" ")
            if tag not in VOID_TAGS:
                if not attributes.endswith("/") or tag in BLOCK_TAGS:
                    state.push(tag, attributes)
        elif page.startswith("<!--", lt):
            if page.startswith(">", lt + 4) or page.startswith("->", lt + 4):
                at = page.find(">", lt + 4) + 1
            else:
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
        elif follow in ("!", "?"):
            stop = page.find(">", lt)
            at = n if stop < 0 else stop + 1
        else:
            say("<")
            at = lt + 1
    end()
    return out


def first_pass(block: Block, rules: Rules, stops: frozenset[str]) -> None:
    """good, bad, short or near (the last two are ambiguous), by markup, length, link density and stop-word density."""
    words = LETTERS.findall(block.text.lower())
    block.stop_density = sum(w in stops for w in words) / max(1, len(words))
    length = len(block.text)
    if block.marked:
        block.first = "marked"
    elif block.link_density > rules.links:
        block.first = "bad"
    elif length < rules.short or block.tag in HEADINGS:
        block.first = "bad" if "©" in block.text and not block.inside else "short"
    elif block.stop_density >= rules.dense:
        block.first = "good" if length >= rules.long else "near"
    elif block.stop_density >= rules.sparse:
        block.first = "near"
    else:
        block.first = "near" if block.inside else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided neighbours.

    Where the page has article or main elements with any text that is not marked or linked away, only these count.
    Between a good and a bad neighbour a block of an article, a block of middling length and a heading before good text
    are good. Blocks that markup marks are bad and are no one's neighbour. Without any decided block, ambiguous ones are good.
    """
    contained = any(b.inside and b.first in ("good", "near", "short") for b in blocks)
    for b in blocks:
        if b.first == "marked" or (contained and not b.inside):
            b.label = "bad"
    rest = [b for b in blocks if not b.label]
    known = [b.first if b.first in ("good", "bad") else "" for b in rest]
    before, after = list(known), list(known)
    for k in range(1, len(rest)):
        before[k] = known[k] or before[k - 1]
    for k in range(len(rest) - 2, -1, -1):
        after[k] = known[k] or after[k + 1]
    some = "good" in known
    for b, own, left, right in zip(rest, known, before, after, strict=True):
        if own:
            b.label = own
        elif not left and not right:
            b.label = "good"
        elif b.inside or not some:
            b.label = "bad" if "good" not in (left, right) and left and right and some else "good"
        elif b.tag in HEADINGS:
            b.label = right or left
        elif b.first == "near":
            b.label = "good" if "good" in (left, right) else "bad"
        else:
            b.label = "good" if (left or right) == (right or left) == "good" else "bad"


def classified(page: str | None, rules: Rules, stops: frozenset[str]) -> list[Block]:
    """The page's blocks with both labels. Where nothing but blocks in headers, menus or forms could be text, these are
    judged like others."""
    blocks = blocks_of(page or "")
    for weak in (True, False):
        for b in blocks:
            if not weak and b.marked == "weak" and b.tag not in ("nav", "menu", "header"):
                b.marked = ""
            b.label = ""
            first_pass(b, rules, stops)
        second_pass(blocks)
        if any(b.label == "good" for b in blocks):
            break
    return blocks


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    return "\n\n".join(b.text for b in classified(page, rules, frozenset(rules.stop_words)) if b.label == "good")


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html): good blocks joined by an empty line.

    Null and empty pages, and pages without text, have '' and 0. Rows stand for themselves: repeated ones are extracted
    each, null ids and urls stay null, there are no ties; other columns are ignored, whatever their names; an empty
    table gives no rows. A page is read whole, however long, in time linear in its length.
    """
    bound_arrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = frozenset(rules.stop_words)
        for b in batches:
            for i, j in pieces(utf8(b.column(2))[1]):
                texts = ["\n\n".join(x.text for x in classified(p, rules, stops) if x.label == "good") for p in b.column(2).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return own.mapInArrow(run, EXTRACTED)


def page_blocks(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, block, text, length, link_density, stop_density, first, label) of every block, for tuning the rules."""
    bound_arrow(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = frozenset(rules.stop_words)
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()]
        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(i, k, x.text, len(x.text), x.link_density, x.stop_density, x.first, x.label) for k, x in enumerate(classified(p.as_py(), rules, stops))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["html"]).mapInArrow(run, BLOCKS)


def op12_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all `pages`."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
