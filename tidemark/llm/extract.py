"""Main text of web pages by two passes over blocks.

A page is read once into blocks: runs of text between block-level tags, each with
its length, the length of its link text, its share of stop words and the container
that it lies in. The first pass labels each block by itself: blocks of boilerplate
containers and link-heavy blocks are bad; long blocks with enough stop words are
good; the rest is short or near good, undecided. The second pass gives each
undecided block the label of its nearest decided neighbours, within the page's
article where it marks one.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table

# Common words of English, German, French, Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is it that for on with as was be by are this or an at from not have has had but they you we his her he she which will can all if there so "
    "der die das und ein eine einer zu in den von mit ist im nicht sich auf für als auch an es dem des wird aus bei sie er wie oder war nach über "
    "le la les de des du et un une en que qui dans pour par sur est pas au aux il elle ce se ne avec plus ou sont son sa ses "
    "el los las del y que en un una por con no para su al lo como es se más o pero sus le ha sin".split()
)
# Elements whose text is no text of the page, elements that hold boilerplate, elements that end a block.
UNSEEN = frozenset("head script style noscript template svg math canvas iframe object audio video map".split())
BOILERPLATE = frozenset("nav header footer aside form button select textarea dialog menu".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li link main menu meta nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p li dt dd tr td th option".split())

# Words in class, id or role that mark boilerplate. A token such as "post-comments" is marked by its first or its last part,
# one such as "has-sidebar" is not, nor one that ends in a state, such as "comments-open". What READERS wrote never counts as text; what STRONG words mark
# does where it holds all of the page's articles, what WEAK words mark (and a form) where it holds an article, or most of the page's running text.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
STRONG = frozenset(
    "cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs pagination pager footer contentinfo newsletter subscribe signup login popup modal".split()
)
WEAK = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner notice overlay sidebar side-bar widget widgets related recommended recommendations share sharing social "
    "menu header masthead toolbar skip search tag tags complementary alert".split()
)
NOT_NOTED = frozenset("has no not with without is hide show enable enabled disable disabled".split())
STATES = frozenset("open opened closed down up sticky accepted active inactive visible shown hidden on off loaded ready".split())
#: Marks readers' words where it stands outside an article; inside it is a part of the text.
DISCUSSION = "discussion"
#: Sentences that make a page of short blocks a text.
FEW = 3
SENTENCE_ENDS = ".!?…。！？\"'”’)"
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element's attributes as browsers read them: a value in quotes, or all up to white space or the tag's end.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")  # not the end of a value without quotes
HIDING = re.compile(r"display\s*:\s*none", re.I)
#: A comment, a declaration, or a tag with its attributes; one whose quotes are not closed ends at the next mark, one that the page's end cuts off counts too.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|=)*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
RAW_TEXT = {name: re.compile(rf"</{name}(?=[\s>/]|$)", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    main: bool
    heading: bool
    preformatted: bool
    note: int


def noted(said: str) -> str:
    """readers, strong, weak or nothing: what the tokens of class, id and role mark."""
    found = set()
    for token in said.lower().split():
        parts = re.split("[-_]+", token)
        if NOT_NOTED.isdisjoint(parts) and (len(parts) == 1 or parts[-1] not in STATES):
            ends = {token, parts[0], parts[-1]}
            found |= {kind for kind, words in (("readers", READERS), ("strong", STRONG), ("weak", WEAK)) if not words.isdisjoint(ends)}
    return next((kind for kind in ("readers", "strong", "weak") if kind in found), "")


class Open:
    """The open elements, with counts by kind, so that a tag costs the same at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # name, unseen, boilerplate, main, note
        self.places: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.headings = 0

    def top(self) -> tuple[str, bool, bool, bool, int]:
        return self.stack[-1] if self.stack else ("", False, False, False, -1)

    def count(self, name: str) -> int:
        return len(self.places.get(name, ()))

    def push(self, element: tuple[str, bool, bool, bool, int]) -> None:
        name, place = element[0], len(self.stack)
        self.stack.append(element)
        self.places.setdefault(name, []).append(place)
        if name in MAIN or name in BOILERPLATE:
            self.sections.append(place)
        self.headings += name in HEADINGS

    def pop(self) -> None:
        name = self.stack.pop()[0]
        self.places[name].pop()
        if name in MAIN or name in BOILERPLATE:
            self.sections.pop()
        self.headings -= name in HEADINGS

    def close(self, name: str) -> None:
        """An end tag: closes the last element of that name; but not beyond the section that it stands in, if it is of a kind found in texts."""
        if not self.count(name):
            return
        place = self.places[name][-1]
        inside = self.sections and self.sections[-1] > place
        if not inside or name in CLOSED_BY_BLOCK or name in MAIN or name in BOILERPLATE or name in ("div", "section", "body", "html"):
            while len(self.stack) > place:
                self.pop()


def blocks_of(page: str, low: int = 70, links: float = 0.3) -> list[Block]:
    """The page's blocks in order, empty ones left out; time is linear in the page's length, whatever its depth."""
    found: list[Block] = []
    open_, parts = Open(), []
    #: of each element with a note: the note around it, its kind, how many articles it holds
    around: list[int] = []
    kinds: list[str] = []
    holds: list[int] = []
    articles = 0
    link_chars = 0
    heading = False

    def flush() -> None:
        nonlocal link_chars, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, _, boilerplate, main, note = open_.top()
                found.append(Block(text, link_chars, boilerplate, main, heading, open_.count("pre") > 0, note))
            parts.clear()
        link_chars, heading = 0, open_.headings > 0

    def text(raw: str) -> None:
        nonlocal link_chars
        if raw and not open_.top()[1]:
            plain = html.unescape(raw)
            parts.append(plain)
            if open_.count("a"):
                link_chars += len(plain)

    at = 0
    while match := MARKUP.search(page, at):
        text(page[at : match.start()])
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        closing, attributes = match[1] or match[4], match[3] or match[6] or ""
        if name in BLOCKS or name in UNSEEN:
            flush()
        if closing:
            open_.close(name)
            heading = open_.headings > 0
            continue
        if name in VOID or name not in BLOCKS and SELF_CLOSED.search(attributes):
            continue
        if name in CLOSED_BY_BLOCK and open_.top()[0] == name:
            open_.pop()
        _, unseen, boilerplate, main, note = open_.top()
        said: dict[str, str] = {}
        for own in ATTRIBUTE.finditer(attributes):
            said.setdefault(own[1].lower(), own[2] or own[3] or own[4] or "")  # the first of a name counts
        unseen = unseen or name in UNSEEN or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(said.get("style", "")))
        marked = noted(f"{said.get('class', '')} {said.get('id', '')} {said.get('role', '')}")
        if not marked and DISCUSSION in f"{said.get('class', '')} {said.get('id', '')}".lower().split() and not open_.count("article"):
            marked = "readers"
        if name in MAIN or said.get("role", "").lower() == "main":
            main = True
            if not marked:
                articles += 1
                if note >= 0:
                    holds[note] += 1
        elif name == "form":  # a page of some frameworks is one form
            marked = marked or "weak"
        # a header inside the article may hold its title; anywhere else it is the site's
        elif name in BOILERPLATE:
            boilerplate = boilerplate or not (name == "header" and main)
        if marked and name not in MAIN and name not in ("body", "html") and not (main and marked == "weak" and name in ("header", *HEADINGS)):
            around.append(note)
            kinds.append(marked)
            holds.append(0)
            note = len(around) - 1
        open_.push((name, unseen, boilerplate, main, note))
        heading = heading or name in HEADINGS
        if name in RAW_TEXT:
            end = RAW_TEXT[name].search(page, at)
            at = end.start() if end else len(page)
    text(page[at:])
    flush()
    return settled(found, around, kinds, holds, articles, low, links)


def settled(found: list[Block], around: list[int], kinds: list[str], holds: list[int], articles: int, low: int, links: float) -> list[Block]:
    """The blocks, those under a note marked as boilerplate, unless what it marks holds what its kind asks for."""
    running = [0] * len(around)
    total = 0
    for block in found:
        if not block.boilerplate and len(block.text) >= low and block.link_chars <= links * len(block.text):
            total += len(block.text)
            if block.note >= 0:
                running[block.note] += len(block.text)
    for i in range(len(around) - 1, -1, -1):  # an inner note comes after the outer one
        if around[i] >= 0:
            running[around[i]] += running[i]
            holds[around[i]] += holds[i]
    marks: list[bool] = []
    for i, outer in enumerate(around):
        spared = {"readers": False, "strong": 0 < articles == holds[i], "weak": holds[i] > 0 or 2 * running[i] > total}
        own = not spared[kinds[i]]
        marks.append(own or outer >= 0 and marks[outer])
    for block in found:
        block.boilerplate = block.boilerplate or block.note >= 0 and marks[block.note]
    return found


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, low: int, high: int, stop_low: float, stop_high: float, links: float, known: bool) -> str:
    """good, bad, near or short, by the block alone; known: whether the page's language is one of the stop words'."""
    if block.boilerplate:
        return "bad"
    size = len(block.text)
    linked = block.link_chars > links * size and not block.main
    if linked and (size <= high or block.link_chars > 2 * links * size):
        return "bad"
    if size < low:
        return "short" if block.link_chars < size or block.main else "bad"
    if not known or foreign(block.text):  # stop words tell nothing: length and links do
        return "near" if linked or size <= high else "good"
    density = stop_density(block.text)
    if density >= stop_high:
        return "good" if size > high and not linked else "near"
    if density >= stop_low and not linked:
        return "near"
    return "short" if block.main or block.preformatted else "bad"


def foreign(text: str) -> bool:
    """Whether most letters are of other scripts than the stop words'."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def sentence(block: Block) -> bool:
    """Whether a short block reads like a sentence: some words, no links, an end."""
    return not block.link_chars and block.text[-1] in SENTENCE_ENDS and (len(block.text.split()) >= 3 or foreign(block.text))


def nearest(decided: list[str | None]) -> list[str | None]:
    """For each block the label of the last decided block before it."""
    found, last = [], None
    for label in decided:
        found.append(last)
        last = label or last
    return found


def main_text(page: str | None, low: int = 70, high: int = 200, stop_low: float = 0.15, stop_high: float = 0.25, links: float = 0.3) -> str:
    """The article's text: white space within a block as one space, blocks joined by one space."""
    blocks = blocks_of(page or "", low, links)
    if any(b.main and not b.boilerplate for b in blocks):
        blocks = [b for b in blocks if b.main]
    running = [b for b in blocks if not b.boilerplate and len(b.text) >= low and b.link_chars <= links * len(b.text)]
    known = any(stop_density(b.text) >= stop_low for b in running if not foreign(b.text))
    labels = [first_pass(b, low, high, stop_low, stop_high, links, known) for b in blocks]
    if "good" not in labels:  # a page of short blocks: near good ones decide, else those of a marked article do, or else sentences, if there are a few
        best = "near" if "near" in labels else "short"
        marked = any(b.main for b in blocks)
        told = [x == best and (best == "near" or b.main or not marked and sentence(b)) for x, b in zip(labels, blocks, strict=True)]
        if best == "near" or marked or sum(told) >= FEW:
            labels = ["good" if t else x for x, t in zip(labels, told, strict=True)]
    decided = [x if x in ("good", "bad") and not b.boilerplate else None for x, b in zip(labels, blocks, strict=True)]
    before, after = nearest(decided), nearest(decided[::-1])[::-1]
    kept = []
    for block, label, b, a in zip(blocks, labels, before, after, strict=True):
        inside = {b, a} - {None}
        if label == "near":
            good = "good" in inside
        elif label == "short":  # between a good and a bad neighbour only the article's own blocks and headings are good
            good = inside == {"good"} or "good" in inside and block.main or block.heading and a == "good"
        else:
            good = label == "good"
        if good:
            kept.append(block.text)
    return " ".join(kept)


def extract(pages: DataFrame, **thresholds) -> DataFrame:
    """page_id, url, text of every page; a null page, or one without main text, has the empty text.

    Pages that repeat, and pages with null ids, keep rows of their own; an empty table gives an empty one. A page is
    one row and one task's work, linear in its length. In a language without stop words here, long blocks with few links are good.
    """

    def each(columns: dict[str, list]) -> pa.RecordBatch:
        made = [main_text(h, **thresholds) for h in columns["html"]]
        return pa.RecordBatch.from_arrays([pa.array(columns["page_id"], pa.int64()), pa.array(columns["url"], pa.string()), pa.array(made, pa.string())], ["page_id", "url", "text"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), each, "page_id long, url string, text string")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract(table(spark, sf_dir, "pages"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
