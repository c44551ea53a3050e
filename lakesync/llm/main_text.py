"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides what it can: blocks in menus, headers, footers,
sidebars, notices, adverts, forms and comments are boilerplate; long blocks with many stop words and few links are text.
Runs of blocks that are mostly links are boilerplate unless other blocks stand around them, or before them at the end of an
article (linked sentences, lists of sources); headings are not judged by links.  Everything else (short blocks, long blocks
with few stop words) stays open.  In the second pass open blocks inherit the label of the nearest decided blocks of their
part of the page.  A part is an article or main element, or the page outside of those; where a part has no block that is
decided to be text, its open blocks are.

Defined results: a null or empty page has an empty text; unclosed, crossed and unknown tags are allowed; an unclosed script,
style or comment runs to the end of the page; very long pages are extracted whole, one at a time; an open block between two
decided ones that are as near is text; repeated rows are extracted each; an empty table gives an empty table; other columns
of the input, also such as ``text``, are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages of the corpus (English, German, French, Spanish).
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in
into is it its more my no not of on one or our out she so some than that the their them then there these they this to up was
we were what when which who will with would you your
aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat ich ihr
ihre im ist ja kann mit nach nicht noch nur oder sein sich sie sind so um und uns unter vom von vor war was wenn werden wie
wird wir zu zum zur über
au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me ne nous on ou où par pas
pour plus qu que qui sa sans se ses son sont sur ta te tu un une vous été être à
al como con cuando de del donde el ella en era es esta este esto ha hay la las le lo los me mi muy más ni no nos o para pero
por porque que se ser si sin sobre son su sus también te tiene todo un una unos y ya
""".split())

#: Tags that end a block where they start and where they end.
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody tfoot thead title tr ul
""".split())
#: Tags inside which nothing is text of the page.
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "head", "title", "canvas", "audio", "video")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text, whatever holds them.
FURNITURE_TAGS = frozenset("nav aside footer form menu dialog select button fieldset search".split())
#: Words of class, id and role attributes that say the same.
FURNITURE_WORDS = frozenset("""
ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs captcha comment comments consent
cookie cookies copyright disqus disclaimer footer footnav gdpr header legal login masthead menu modal nav navbar navigation
newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies
reply respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription syndication
teaser toolbar topbar widget widgets complementary contentinfo
""".split())
#: Words that may stand beside them in the name of a piece of furniture ("share-bar", but not "share-price").
PLACE_WORDS = frozenset("""
area articles bar block body box button buttons container form google group icons inline inner item items js link links list mid
panel posts row section site slot stories text top unit wp wrap wrapper
""".split())
#: Furniture words that tell nothing inside an article; a header there is its headline.
_NOT_INSIDE = frozenset({"header", "masthead", "search", "skip", "legal"})
COMMENT_WORDS = frozenset({"comment", "comments", "reply", "replies", "respond", "disqus"})

HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Shorter blocks are open, blocks with a larger share of link characters are links, with more stop words text.
SHORT = 70
MAX_LINK_DENSITY = 0.5
MIN_STOP_DENSITY = 0.2

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?:!|\?)[^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

OPEN, TEXT, BOILERPLATE, LINKS = 0, 1, 2, 3


class Block:
    """Text of the page between two block-level tags, with its links and the part of the page it belongs to."""

    __slots__ = ("pieces", "linked", "part", "furniture", "heading", "breaks")

    def __init__(self, part: int, furniture: bool, heading: bool) -> None:
        self.pieces: list[str] = []
        self.linked = 0
        self.part, self.furniture, self.heading, self.breaks = part, furniture, heading, 0

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def _hints(attrs: str) -> tuple[set[str], set[str], bool]:
    """The words of class, id and role, the furniture words of names of furniture, and whether the element is hidden.

    A name tells furniture if it has a furniture word and no words but those and ``PLACE_WORDS``: a wrapper may be named after
    what it lacks or stands beside ("no-sidebar"), a section after what it is about ("social-history").
    """
    words: set[str] = set()
    furniture: set[str] = set()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", '""', attrs)))
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            for token in value.split():
                told = {w.lower() for w in _NAME_PARTS.findall(token) if len(w) > 1}
                words |= told
                if told - PLACE_WORDS <= FURNITURE_WORDS:
                    furniture |= told - PLACE_WORDS
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
    return words, furniture, hidden


def blocks_of(page: str) -> list[Block]:
    """All blocks of a page in order, the empty ones too."""
    # Open elements: name, the part they open (or that of their parent), whether they are furniture.
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    parts, in_link, at = 0, 0, 0
    found = [Block(0, False, False)]

    def add(piece: str) -> None:
        if piece:
            found[-1].pieces.append(piece)
            if not piece.isspace():
                found[-1].breaks = 0
                if in_link:
                    found[-1].linked += len(piece.strip())

    def cut() -> None:
        if found[-1].pieces:
            found.append(Block(stack[-1][1], stack[-1][2], stack[-1][0] in HEADINGS))
        else:
            found[-1].part, found[-1].furniture, found[-1].heading = stack[-1][1], stack[-1][2], stack[-1][0] in HEADINGS

    while True:
        token = _TOKEN.search(page, at)
        add(page[at: token.start()] if token else page[at:])
        if token is None:
            return found
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            continue
        attrs, closing = token["attrs"] or token["attrs2"] or "", token["close"] or token["close2"]
        if closing:
            if name == "a":
                in_link = 0
            if name in BLOCK_TAGS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                cut()
            elif len(stack) > 1 and stack[-1][0] == name:
                del stack[-1]
                cut()
            continue
        if name in RAW_TAGS:
            if not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end is None and name == "head":
                    continue
                at = end.end() if end else len(page)
            continue
        if name == "br":
            found[-1].breaks += 1
            if found[-1].breaks > 1:
                cut()
            add(" ")
            continue
        if name in ("td", "th", "img"):
            add(" ")
        if name == "a":
            in_link = 1
        words, named, hidden = _hints(attrs) if attrs else (set(), set(), False)
        _, part, furniture = stack[-1]
        around = furniture
        if name in ("article", "main") and not words & COMMENT_WORDS:
            inside = any(n in FURNITURE_TAGS for n, _, _ in stack)
            if part == 0 and not inside:
                parts += 1
                part, furniture = parts, False
        elif name not in ("html", "body"):
            told = named - _NOT_INSIDE if part else named
            furniture = furniture or name in FURNITURE_TAGS or bool(told) or (name == "header" and not part)
        furniture = furniture or hidden
        if name in BLOCK_TAGS:
            in_link = in_link if name == "a" else 0
            if name == "p":
                while stack[-1][0] == "p":
                    del stack[-1]
            if name not in VOID_TAGS:
                stack.append((name, part, furniture))
            cut()
        elif furniture and not around and name not in VOID_TAGS and not attrs.rstrip().endswith("/"):
            stack.append((name, part, furniture))
            cut()


def _label(block: Block, text: str, last: bool) -> int:
    if "©" in text and len(text) < 3 * SHORT and (last or not block.part):
        return BOILERPLATE
    if block.linked > MAX_LINK_DENSITY * len(text) and not block.heading:
        return LINKS
    if len(text) < SHORT:
        return OPEN
    words = _WORD.findall(text.lower())
    if words and sum(map(STOP_WORDS.__contains__, words)) >= MIN_STOP_DENSITY * len(words):
        return TEXT
    return OPEN


def first_pass(blocks: list[tuple[Block, str]]) -> list[int]:
    """Labels of the blocks of one part that are no furniture: text, boilerplate or open."""
    labels = [_label(b, t, i == len(blocks) - 1) for i, (b, t) in enumerate(blocks)]
    at = 0
    while at < len(labels):
        end = at + 1
        if labels[at] == LINKS:
            while end < len(labels) and labels[end] == LINKS:
                end += 1
            after = labels[end] != BOILERPLATE if end < len(labels) else blocks[at][0].part > 0
            stays = at > 0 and labels[at - 1] != BOILERPLATE and after
            labels[at:end] = [OPEN if stays else BOILERPLATE] * (end - at)
        at = end
    return labels


def second_pass(labels: list[int]) -> list[int]:
    """Labels of the blocks of one part: an open block takes that of the nearest decided one, text where two are as near.

    Where no block is decided to be text, all open ones are: short ones, and those in languages without known stop words.
    """
    if TEXT not in labels:
        return [TEXT if label == OPEN else label for label in labels]

    def nearest(order: range) -> list[tuple[int, int]]:
        label, away, out = OPEN, 0, []
        for i in order:
            label, away = (labels[i], 0) if labels[i] != OPEN else (label, away + 1)
            out.append((label, away))
        return out

    before, after = nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))[::-1]
    final = []
    for label, (a, to_a), (b, to_b) in zip(labels, before, after):
        if label == OPEN:
            if a == OPEN or b == OPEN:
                label = a or b
            elif a == b or to_a == to_b:
                label = a if a == b else TEXT
            else:
                label = a if to_a < to_b else b
        final.append(label)
    return final


def main_text(page: str | None) -> str:
    """The text of a page: its article's blocks, two line breaks between them."""
    if not page:
        return ""
    blocks = [(b, t) for b in blocks_of(page) if (t := b.text())]
    final = [BOILERPLATE] * len(blocks)
    members: dict[int, list[int]] = {}
    for i, (b, _) in enumerate(blocks):
        # Furniture has been decided by its place and says nothing about its neighbours.
        if not b.furniture:
            members.setdefault(b.part, []).append(i)
    for inside in members.values():
        for i, label in zip(inside, second_pass(first_pass([blocks[i] for i in inside]))):
            final[i] = label
    if any(b.part and final[i] == TEXT for i, (b, _) in enumerate(blocks)):
        final = [label if b.part else BOILERPLATE for (b, _), label in zip(blocks, final)]
    return "\n\n".join(t for (_, t), label in zip(blocks, final) if label == TEXT)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
