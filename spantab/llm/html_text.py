"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what it
can: blocks in menus, headers, footers, sidebars, notices, adverts, forms and
comments, and blocks that are mostly links, are boilerplate; long blocks with
enough stop words are text; long blocks with none are boilerplate unless they
stand in an article, or are sentences in a page without one. Short and middling
blocks, and mostly linked ones in an article, stay open. The second pass
gives each open block the label of its nearest decided neighbours: both alike,
or the nearer of two that differ; in an article the neighbours are those of
the article. Where nothing is decided as text, open blocks are text: all of an
article, and in a page without one what holds no link.

Inside an article a class, id or role makes a block boilerplate only if it says
nothing else: ``share-buttons`` does, ``share-price`` and ``related-work`` do not.

Rules for odd input: a null or empty page, and one without text, gives the
empty string; broken markup is read as far as it goes (unclosed containers end
with the page, an article ends unclosed menus before it); repeated rows are
pages of their own; an empty table gives no rows; other columns pass through
(``text`` replaces one of this name). Pages are read whole, one at a time, in
time linear in their length, broken markup included.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from spantab.llm.ordering import packed, quoted, unpacked

MAX_LINK_DENSITY = 0.33
#: Share of link characters up to which a long block in an unknown language is text.
MAX_LINKED = 0.1
#: Characters below which a block is too short to judge, and from which on few stop words suffice.
SHORT = 70
LONG = 200
STOP_LOW = 0.10
STOP_HIGH = 0.25
#: Share of stop words up to which a block of sentences counts as one of an unknown language.
STOP_NONE = 0.02

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about all an and are as at be been but by can for from had has have he her his if in is it its more not of on
    one only or other so than that the their there they this to was we were what when which who will with would you
    aber als am an auch auf aus bei das dem den der des die durch ein eine einen er es für hat im in ist mit nach
    nicht noch nur oder sich sie sind so über um und von vor war wie zu zum zur
    au aux avec ce cette dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour
    qui que sa se ses son sont sur un une vous y
    al como con de del el ella en entre era es esta este fue ha la las le lo los más mi muy no o para pero por porque
    que se si sin sobre su sus también un una uno ya y
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead title tr ul
    """.split()
)
#: Elements that nest and are tracked; the others only end blocks.
CONTAINERS = frozenset(
    """
    article aside blockquote body details dialog div fieldset figure footer form header main menu nav ol section table ul
    """.split()
)
BOILERPLATE_TAGS = frozenset("aside dialog fieldset footer form menu nav".split())
UNCLOSED_TAGS = frozenset("footer form header menu nav".split())
#: Elements without readable text; what is in them is skipped up to their end tag.
SILENT_TAGS = "script style title noscript template svg math iframe object head button select textarea canvas audio video".split()
#: Words in class, id and role attributes that name what is not the article.
BOILERPLATE_NAMES = frozenset(
    """
    ad ads advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment comments complementary
    consent contentinfo cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar
    navigation newsletter notice notification pager pagination popup promo promoted promotion related reply respond
    search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget
    """.split()
)
#: Words that say nothing of a block's contents; beside boilerplate words they make a name of boilerplate.
NEUTRAL_NAMES = frozenset(
    """
    area article articles bar block bottom box button buttons container content form group icon icons inline inner item
    items left link links list main more news outer page panel post posts reader right row section site slot stories
    story thread title top unit user wrap wrapper
    """.split()
)
#: Of these, what is no wrapper of an article, whatever other words stand beside it.
ASIDE_NAMES = frozenset("comment comments cookie disqus related reply respond".split())
#: Comments, declarations and tags; quoted attribute values may hold ">", and a tag with a stray quote ends at the next ">".
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(
    r"""(?:^|\s)hidden(?=[\s/=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none)""",
    re.IGNORECASE,
)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE) for tag in SILENT_TAGS}
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"""[.!?。！？؟।…]["'»”’)」』]*(?:\s|$)|[。！？]""")
_UNCLOSED = re.compile(r"<!--|<!\[CDATA\[")


@dataclass
class Block:
    text: str
    link_chars: int
    boilerplate: bool
    article: int  # which article or main element it stands in; 0 if in none


@dataclass
class _Reader:
    """Collects blocks while the markup is read."""

    blocks: list[Block] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    link_chars: int = 0
    in_link: bool = False
    marked: bool = False
    #: (tag, is boilerplate, number of the article, is boilerplate not only by a word in a compound name)
    open: list[tuple[str, bool, int, bool]] = field(default_factory=list)
    articles: int = 0
    #: How many elements of each tag are open, and how many that no article in them overrides.
    depth: Counter = field(default_factory=Counter)
    barred: int = 0

    def add(self, raw: str) -> None:
        if raw:
            self.words.append(raw)
            if self.in_link:
                self.link_chars += len(raw.strip())

    def end_block(self) -> None:
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            if text:
                _, bad, article, _ = self.open[-1] if self.open else ("", False, 0, False)
                self.blocks.append(Block(text, min(self.link_chars, len(text)), bad or self.marked, article))
        self.words, self.link_chars, self.marked = [], 0, False

    def start(self, tag: str, attributes: str) -> None:
        _, bad, article, sure = self.open[-1] if self.open else ("", False, 0, False)
        named = tag != "body" and (is_boilerplate_name if article else is_named)(attributes)
        if tag in ("article", "main") and not named and not article:
            # a menu or header that was never closed does not hold the article, and a wrapper with a listed word
            # among others in its name is none; other boilerplate may
            if not self.barred:
                self.articles += 1
                bad, sure, article = False, False, self.articles
        page_header = tag == "header" and not article
        sure = sure or tag in BOILERPLATE_TAGS or page_header or bool(_HIDDEN.search(attributes))
        sure = sure or (named and is_aside(attributes))
        self.open.append((tag, bad or named or sure, article, sure))
        self.depth[tag] += 1
        self.barred += sure and tag not in UNCLOSED_TAGS

    def end(self, tag: str) -> None:
        """Close the innermost element of this tag with all in it; a stray end tag closes none."""
        last = None
        while self.depth[tag] and last != tag:
            last, _, _, sure = self.open.pop()
            self.depth[last] -= 1
            self.barred -= sure and last not in UNCLOSED_TAGS


def is_named(attributes: str) -> bool:
    """Whether a class, id or role names boilerplate."""
    values = ("".join(found).lower() for found in _NAMES.findall(attributes))
    return any(word in BOILERPLATE_NAMES for value in values for word in re.split(r"[^a-z]+", value))


def _name_words(attributes: str) -> list[set[str]]:
    """The words of each single class, id or role."""
    names = (name for found in _NAMES.findall(attributes) for name in "".join(found).lower().split())
    return [{w for w in re.split(r"[^a-z]+", name) if w} for name in names]


def is_aside(attributes: str) -> bool:
    """Whether a name is made of boilerplate words only, or holds one that no wrapper of an article has."""
    return any(ws and (ws <= BOILERPLATE_NAMES or ws & ASIDE_NAMES) for ws in _name_words(attributes))


def is_boilerplate_name(attributes: str) -> bool:
    """Whether a name says boilerplate and nothing else."""
    return any(ws & BOILERPLATE_NAMES and ws <= BOILERPLATE_NAMES | NEUTRAL_NAMES for ws in _name_words(attributes))


def _cut_short(page: str, start: int, end: int) -> bool:
    """Whether the markup from start to end is a comment or CDATA section that no mark of its own ends."""
    marks = (("<!--", "-->"), ("<![CDATA[", "]]>"))
    return any(page.startswith(a, start) and not page.endswith(b, start + len(a), end) for a, b in marks)


def blocks_of(page: str) -> list[Block]:
    reader, at = _Reader(), 0
    # no tag ends beyond this place; without it each unclosed one would be sought up to the end of the page
    limit = page.rfind(">") + 1
    endless: set[str] = set()
    while at < limit:
        mark = _MARKUP.search(page, at, limit)
        if mark is None:
            break
        reader.add(page[at : mark.start()])
        at = mark.end()
        if at == limit and _cut_short(page, mark.start(), limit):
            at = len(page)
        tag, closing, attributes = (mark[2] or mark[5] or "").lower(), bool(mark[1] or mark[4]), mark[3] or mark[6] or ""
        if not tag:
            continue
        if tag in _ENDS and not closing:
            if not attributes.endswith("/"):
                end = None if tag in endless else _ENDS[tag].search(page, at, limit)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag == "a":
            reader.in_link = not closing
        elif tag in BLOCK_TAGS or tag in CONTAINERS:
            reader.end_block()
            if tag in CONTAINERS:
                reader.end(tag) if closing else reader.start(tag, attributes)
            elif attributes and not closing:
                article = bool(reader.open and reader.open[-1][2])
                named = (is_boilerplate_name if article else is_named)(attributes)
                reader.marked = named or bool(_HIDDEN.search(attributes))
    rest = page[at:]
    unclosed = _UNCLOSED.search(rest)
    reader.add(rest[: unclosed.start()] if unclosed else rest)
    reader.end_block()
    return reader.blocks


def first_pass(block: Block, sentences_are_text: bool = False) -> bool | None:
    """True for text, False for boilerplate, None where the block alone does not tell.

    ``sentences_are_text`` admits long blocks of sentences without known stop
    words and with few links: those of another language.
    """
    size = len(block.text)
    links = block.link_chars / size
    if block.boilerplate:
        return False
    if links > MAX_LINK_DENSITY:
        return None if block.article else False
    if size < SHORT:
        return None if not block.link_chars or block.article else False
    words = _LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOP_HIGH or (stops >= STOP_LOW and size >= LONG) or (block.article and size >= LONG):
        return True
    if sentences_are_text and stops <= STOP_NONE and links <= MAX_LINKED and _SENTENCE_END.search(block.text):
        return True
    return None if stops >= STOP_LOW or block.article else False


def labels(blocks: list[Block]) -> list[bool]:
    """Which blocks are text."""
    has_article = any(b.article and not b.boilerplate for b in blocks)
    decided = [first_pass(b, not has_article) for b in blocks]
    if not any(decided):
        # no block has known stop words enough: another language, whose long blocks with few links are the text
        decided = [
            d if b.boilerplate or len(b.text) < SHORT or b.link_chars > MAX_LINKED * len(b.text) else True
            for b, d in zip(blocks, decided)
        ]
    if not any(decided) and not has_article:
        # a page of short blocks: nothing but boilerplate decided, so the open blocks are the text
        return [label is None for label in decided]

    def neighbours(order) -> list[tuple[bool, int] | None]:
        """Per block the label and place of the last decided one before it; articles keep to themselves."""
        last: dict[int, tuple[bool, int]] = {}
        found: list[tuple[bool, int] | None] = [None] * len(blocks)
        for i in order:
            b, label = blocks[i], decided[i]
            found[i] = last.get(b.article)
            # boilerplate inside an article says nothing of the blocks around it
            if label is not None and not (b.article and b.boilerplate):
                last[b.article] = (label, i)
        return found

    before, after = neighbours(range(len(blocks))), neighbours(range(len(blocks) - 1, -1, -1))
    out = []
    for i, (block, label) in enumerate(zip(blocks, decided)):
        if label is None:
            sides = [s for s in (before[i], after[i]) if s]
            nearest = min(sides, key=lambda s: (abs(s[1] - i), not s[0]), default=None)
            label = nearest[0] if nearest else bool(block.article)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, good in zip(blocks, labels(blocks)) if good)


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def text_column(page: Column) -> Column:
    return arrow_udf(_main_texts, "string")(page)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each as ``text``."""
    read = pages.select(packed(pages), text_column(quoted(html_col)).alias("text"))
    return read.select(*unpacked(read, "text"), "text")
