"""Main text of web pages: flat text blocks judged by a decision tree.

A page is scanned once into flat blocks: the text between two borders of block elements. A block is described by its own and
its neighbours' word counts and link densities, its kind of element, what it says (a notice about cookies or rights; what follows a
heading of readers' comments), and by marks of what encloses it (an article; something whose element, class, id or role says
menu, advert, notice, comments and the like). A decision tree, grown on the small labelled tables below, says which blocks are main
text.

A class or an id is a suspicion only: words such as `has-sidebar` or `category-social` tell of the page's make-up, and an element
that holds what marks an article, and more than half of the page's running text, is the article's own frame whatever it is called.
The same goes for forms and headers. Menus, footers, dialogs and what is hidden are beside the article as they stand.

Defined results: null or empty html has no text; markup that ends early counts as closed at its end; comments, scripts,
styles and the head are never text; rows without page_id are pages like others; repeated rows are extracted each; an empty
table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A tag up to its end or its first quote; tags with quotes are read on by Tags.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)[^>\"']*+(>|[\"'])|<[!?][^>]*>|<[/!?a-zA-Z][^>]*\Z", re.S)
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What such elements hold is never text; their content is not markup.
RAW = frozenset("script style template noscript textarea title iframe svg object select annotation annotation-xml".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDES = frozenset("nav aside footer dialog button menu".split())
SUSPECTS = frozenset("form fieldset label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or an id that say that something is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adsbygoogle adslot adunit adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted promotion banner cookie cookies "
    "consent gdpr notice notices notification alert sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar "
    "comment comments commentlist reply replies respond discussion disqus share sharing social related recommended recommendations widget widgets "
    "popup modal overlay newsletter subscribe subscription signup login signin search toolbar pagination pager copyright legal disclaimer skip "
    "toc outbrain taboola form remarks guestbook".split()
)
#: Such a word before others says that the rest of a class name is about the page, not about the element.
ABOUT = frozenset("has with no without is not category cat tag topic type format layout page theme".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())
#: An open element ends where one of these begins.
ENDS = {"p": BLOCKS - {"body", "html"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}

#: A notice about cookies, one about rights or letters (beside an article only), and a line below which readers speak.
_COOKIES = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|privacy|preferences|settings|einverstanden|zustimm|datenschutz|acceptez|politique|aceptar?|privacidad)|\b(?:accept|consent|zustimm|acceptez|acepta).*\bcookies?\b", re.I | re.S)
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright)|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b|^(?:subscribe|sign up)\b.*\b(?:newsletter|inbox|e-?mail)", re.I | re.S)
_REMARKS = re.compile(
    r"(?:\d+ )?(?:(?:reader|user|visitor)s?'? )?(?:comments?|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?|\d+ (?:replies|reply|responses?|remarks?|reactions?|antworten|réponses?|respuestas?)"
    r"|\d+ (?:readers?|people|users?|visitors?) (?:wrote|said|say|commented|replied)|(?:leave|post|write|add) a (?:comment|reply)|(?:what )?(?:our )?readers (?:say|said|think|wrote)|join the conversation",
    re.I,
)
#: A notice has few words; below fewer words of running text, readers have nothing to speak about yet.
NOTICE_WORDS, REMARKS_AFTER = 60, 20

FEATURES = ("aside", "article", "notice", "remarks", "heading", "paragraph", "item", "words", "links", "words_before", "links_before", "words_after", "links_after")


class Tags:
    """Tags of one page. Quoted attributes may have any length; each quote is looked at once, however quotes are unbalanced."""

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()  # quotes behind which no tag ends
        self.last = {q: page.rfind(q) for q in "\"'"}

    def _end(self, quote: int) -> int:
        """The > that ends the tag of this opening quote, or -1 if the quotes leave none."""
        page, seen = self.page, []
        while page[quote] != ">":
            if quote in self.dead or quote >= self.last[page[quote]]:
                break
            seen.append(quote)
            m = _MARK.search(page, page.find(page[quote], quote + 1) + 1)
            if not m:
                break
            quote = m.start()
        else:
            return quote
        self.dead.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name, attributes) of the first markup from `at` on; no name if it is no tag."""
        m = _TAG.search(self.page, at)
        if not m:
            return None
        if not m[2]:
            return m.start(), m.end(), False, "", ""
        end, behind = m.end() - 1, m.end(2)
        if m[3] != ">":
            end = self._end(end)
            while end < 0:  # unbalanced, unless the name ends before a quote in it
                behind = max(self.page.rfind(q, m.start(2), behind) for q in "\"'")
                if behind < 0:  # passed over up to the next >
                    return m.start(), self.page.find(">", m.end()) + 1 or len(self.page), False, "", ""
                end = self._end(behind)
        return m.start(), end + 1, bool(m[1]), self.page[m.start(2) : behind].lower(), self.page[behind:end]


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    strong: bool = False
    suspect: int = -1
    article: bool = False
    kind: str = ""
    element: int = -1
    aside: bool = False
    remarks: bool = False

    def close(self) -> bool:
        self.text = " ".join(html.unescape("".join(self.parts)).split())
        self.words = self.text.count(" ") + 1 if self.text else 0
        held = len(html.unescape(" ".join(self.linked)).split())
        self.links = min(1.0, held / self.words) if self.words else 0.0
        self.notice = self.words <= NOTICE_WORDS and bool(_COOKIES.search(self.text) or (not self.article and _RIGHTS.search(self.text)))
        return bool(self.text)

    def running(self) -> int:
        return self.words if self.links < 0.5 and not self.strong else 0


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is beside the article, may be, and is one."""
    strong, suspect = tag in ASIDES, tag in SUSPECTS or (tag == "header" and not in_article)
    article = tag in ("article", "main")
    if attributes.strip(" \t\n\r\f/"):
        for name, *values in _ATTR.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                names = [[w.lower() for w in _WORD.findall(one)] for one in value.split()]
                words = {w for one in names if one and not (len(one) > 1 and one[0] in ABOUT) for w in one}
                own = bool(words & ARTICLE_WORDS)
                if words & ASIDE_WORDS or ("header" in words and not own and not in_article):
                    suspect = suspect or tag not in ("html", "body", "article", "main")
                    article = article and not words & ASIDE_WORDS
                elif own and tag in ("div", "section"):
                    article = True
            elif name == "role":
                strong = strong or value.lower() in ASIDE_ROLES
                article = article or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                strong = True
    return strong, suspect, article


def _judge(blocks: list[Block], above: list[int], marked: list[bool]) -> None:
    """Which suspects are beside the article, from the words that they hold; above: the suspect that encloses each."""
    held = [0] * len(above)
    for b in blocks:
        if b.suspect >= 0:
            held[b.suspect] += b.running()
    for i in range(len(above) - 1, -1, -1):
        if above[i] >= 0:
            held[above[i]] += held[i]
            marked[above[i]] = marked[above[i]] or marked[i]
    half = sum(b.running() for b in blocks) / 2
    beside = []
    for i, outer in enumerate(above):
        beside.append((outer >= 0 and beside[outer]) or not (marked[i] and held[i] > half))
    for b in blocks:
        b.aside = b.strong or (b.suspect >= 0 and beside[b.suspect])


def _find_remarks(blocks: list[Block], parent: list[int], ends: list[int]) -> None:
    """Blocks behind a line that announces readers' comments, up to the end of what encloses that line."""
    spoken, until = 0, 0
    for i, b in enumerate(blocks):
        b.remarks = i < until
        if not b.remarks and not b.aside:
            if spoken >= REMARKS_AFTER and b.words <= 6 and _REMARKS.fullmatch(b.text.rstrip(".:…!")) and (b.kind in HEADINGS or b.text[0].isdigit()):
                outer = parent[b.element] if b.element >= 0 else -1
                until, b.remarks = ends[outer] if outer >= 0 else len(blocks), True
            spoken += b.running()


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks in page order, without empty ones."""
    out: list[Block] = []
    #: Element, beside the article, suspect, in the article, its number, and the block that an inline element beside the article interrupts.
    stack: list[tuple[str, bool, int, bool, int, Block | None]] = []
    opened: Counter[str] = Counter()
    strong = article = False
    suspect = element = -1
    inside = -1  # where in the stack the inline element stands that interrupts a block
    #: Of suspects, the suspect that encloses each and whether it holds what marks an article; of block elements, the one that
    #: encloses each and the number of blocks at its end.
    above: list[int] = []
    marked: list[bool] = []
    parent: list[int] = []
    ends: list[int] = []
    links = 0
    block = Block()

    def finish(done: Block) -> None:
        if done.parts and done.close():
            out.append(done)

    def kind() -> str:
        return next((t for t, *_ in reversed(stack) if t in BLOCKS), "")

    def new() -> Block:
        return Block(strong=strong, suspect=suspect, article=article, kind=kind(), element=element)

    def border() -> None:
        nonlocal block
        if inside >= 0:  # a block that goes on behind an inline element does so as a block of its own if a border stands in it
            *entry, held = stack[inside]
            if held.parts:
                finish(held)
                stack[inside] = *entry, Block(strong=held.strong, suspect=held.suspect, article=held.article, kind=held.kind, element=held.element)
        finish(block)
        block = new()

    def leave(depth: int) -> None:
        nonlocal strong, suspect, article, element, links, block, inside
        while len(stack) > depth:
            tag, _, _, _, own, held = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            _, strong, suspect, article, element, _ = stack[-1] if stack else ("", False, -1, False, -1, None)
            if held is not None:
                inside = -1
                finish(block)
                block = held
            if tag in BLOCKS:
                border()
                ends[own] = len(out)

    def say(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked.append(text)

    at = 0
    lower = None
    tags = Tags(page)
    while True:
        found = tags.next(at)
        if not found:
            say(page[at:])
            break
        start, end, closing, tag, attributes = found
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closing:
            for depth in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if tag not in BLOCKS and stack[depth][0] in BLOCKS:
                    break  # an inline end does not close blocks
            continue
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at)
            if attributes.endswith("/") and tag == "svg":
                continue
            at = len(page) if end < 0 else page.find(">", end) + 1 or len(page)
            continue
        if tag == "br":
            say(" ")
            continue
        for depth in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ENDS) else ():
            if tag in ENDS.get(stack[depth][0], ()):
                leave(depth)
                break
            if stack[depth][0] in BLOCKS and stack[depth][0] not in ENDS:
                break
        if tag in VOID:
            if tag in BLOCKS:
                border()
            continue
        beside, may_be, own = _marks(tag, attributes, article)
        inline = (beside or may_be) and not strong and tag not in BLOCKS and inside < 0
        strong, article = strong or beside, article or own
        if may_be:
            above.append(suspect)
            marked.append(False)
            suspect = len(above) - 1
        if suspect >= 0 and (own or tag == "h1"):
            marked[suspect] = True
        if tag in BLOCKS:
            parent.append(element)
            ends.append(0)
            element = len(parent) - 1
        stack.append((tag, strong, suspect, article, element, block if inline else None))
        opened[tag] += 1
        links += tag == "a"
        if inline:
            inside = len(stack) - 1
            block = new()
        elif tag in BLOCKS:
            border()
    finish(block)
    for i in {e for _, _, _, _, e, _ in stack if e >= 0}:
        ends[i] = len(out)
    for *_, held in reversed(stack):
        if held is not None:
            finish(held)
    head = [b.kind == "head" for b in out]
    _judge(out, above, marked)
    _find_remarks(out, parent, ends)
    return [b for b, beside in zip(out, head) if not beside]


def described(blocks: list[Block]) -> list[tuple[float, ...]]:
    """FEATURES of each block."""
    none = Block()
    none.text, none.words, none.links = "", 0, 0.0
    out = []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else none, blocks[i + 1] if i + 1 < len(blocks) else none
        out.append((float(b.aside), float(b.article), float(b.notice), float(b.remarks), float(b.kind in HEADINGS), float(b.kind in ("p", "blockquote", "pre")), float(b.kind in ("li", "dd", "dt", "td", "th")), b.words, b.links, before.words, before.links, after.words, after.links))
    return out


#: Neighbours in the labelled table: words and link density of running text, a short line, a menu entry, none.
NEIGHBOURS = {"T": (16, 0.0), "t": (4, 0.0), "L": (2, 1.0), "-": (0, 0.0)}
#: Labelled by hand from the usual make-up of pages that mark no article: kind, words, link density; then the blocks
#: before and after, in pairs, with which it is main text and with which it is not.
UNMARKED = [
    ("paragraph", 80, 0.0, "TT Tt tT LL L- -L LT TL -T T- -- tt", ""),
    ("paragraph", 30, 0.1, "TT Tt tT LL L- -L LT TL -T T- -- tt", ""),
    ("paragraph", 17, 0.0, "TT Tt tT LL L- -L LT TL -T T- -- tt", ""),
    ("paragraph", 40, 0.3, "TT Tt tT LT TL", ""),
    ("paragraph", 8, 0.0, "TT Tt tT LT TL T- -T", "LL L- -L"),
    ("paragraph", 3, 0.0, "TT Tt tT LT TL T- -T", "LL L- -L"),
    ("paragraph", 1, 0.0, "TT Tt tT LT T- -T", "LL L- -L"),
    ("paragraph", 40, 0.8, "", "TT Tt LL L- -L TL LT --"),
    ("paragraph", 12, 0.9, "", "TT Tt LL L- -L TL LT --"),
    ("paragraph", 3, 1.0, "", "TT Tt LL L- -L TL LT --"),
    ("block", 70, 0.0, "TT Tt tT LL L- -L LT TL -T T- --", ""),
    ("block", 30, 0.2, "TT Tt tT LL L- -L LT TL -T T- --", ""),
    ("block", 17, 0.0, "TT Tt tT LL L- -L LT TL -T T- --", ""),
    ("block", 8, 0.1, "TT", "LL L- -L T- TL -t t- Lt"),
    ("block", 3, 0.0, "TT", "LL L- -L T- TL -t t- Lt"),
    ("block", 20, 0.8, "", "TT LL L- -L T- TL LT -- tt"),
    ("block", 5, 0.6, "", "TT LL L- -L T- TL LT -- tt"),
    ("block", 2, 1.0, "", "TT LL L- -L T- TL LT -- tt"),
    ("heading", 6, 0.0, "LT TT -T tT", "TL LL L- -L T-"),
    ("heading", 2, 0.0, "LT TT -T tT", "TL LL L- -L T-"),
    ("heading", 14, 0.0, "LT TT -T tT", ""),
    ("heading", 3, 1.0, "", "LL L- TL tL T-"),
    ("item", 20, 0.0, "TT Tt tT tt LT TL", ""),
    ("item", 8, 0.1, "TT", "LL L- -L tL Lt"),
    ("item", 3, 0.0, "TT", "LL L- -L tL Lt"),
    ("item", 15, 0.9, "", "TT LL L- -L LT TL tt"),
    ("item", 2, 1.0, "", "TT LL L- -L LT TL tt"),
]
#: Within an article a run of links is a menu; every other block is main text. Beside it nothing is.
MARKED = [(kind, words, links) for kind in ("paragraph", "block", "heading", "item") for words, links in ((1, 0.0), (3, 0.0), (3, 1.0), (5, 0.2), (9, 0.1), (9, 1.0), (17, 0.0), (40, 0.0), (35, 0.5))]


def labelled_rows() -> list[tuple]:
    """The table as rows: FEATURES, then the label."""

    def row(aside: int, article: int, kind: str, words: int, links: float, around: str, label: int, notice: int = 0, remarks: int = 0) -> tuple:
        return (aside, article, notice, remarks, int(kind == "heading"), int(kind == "paragraph"), int(kind == "item"), words, links, *NEIGHBOURS[around[0]], *NEIGHBOURS[around[1]], label)

    out = [row(0, 0, kind, words, links, pair, label) for kind, words, links, yes, no in UNMARKED for label, pairs in ((1, yes), (0, no)) for pair in pairs.split()]
    for kind, words, links in MARKED:
        for pair in (a + b for a in NEIGHBOURS for b in NEIGHBOURS):
            menu = links == 1.0 and "L" in pair and kind != "heading"
            out += [row(0, 1, kind, words, links, pair, int(not menu)), row(1, 0, kind, words, links, pair, 0), row(1, 1, kind, words, links, pair, 0)]
            out += [row(0, article, kind, words, links, pair, 0, notice, 1 - notice) for article in (0, 1) for notice in (0, 1)]
    return out


@dataclass(frozen=True)
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    share: float = 0.0

    def is_text(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.low is not None:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.share >= 0.5


def grow(rows: list[tuple], depth: int = 10) -> Node:
    """A binary tree by Gini impurity; ties go to the first feature and the lowest cut. The last column is the label."""
    share = sum(r[-1] for r in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return Node(share=share)
    best = None
    for f in range(len(rows[0]) - 1):
        seen = sorted({r[f] for r in rows})
        for a, b in zip(seen, seen[1:]):
            cut = (a + b) / 2
            sides = [r[-1] for r in rows if r[f] <= cut], [r[-1] for r in rows if r[f] > cut]
            impurity = sum(2 * sum(s) * (1 - sum(s) / len(s)) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, cut
    if best is None:
        return Node(share=share)
    _, f, cut = best
    return Node(f, cut, grow([r for r in rows if r[f] <= cut], depth - 1), grow([r for r in rows if r[f] > cut], depth - 1), share)


@cache
def default_tree() -> Node:
    return grow(labelled_rows())


def main_text(page: str | None, tree: Node | None = None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    tree = tree or default_tree()
    return "\n".join(b.text for b, row in zip(blocks, described(blocks)) if tree.is_text(row))


def extract_pages(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    tree = grow(labelled) if labelled else default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
