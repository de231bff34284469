"""Main text of web pages by scoring the tree of blocks.

A page is read once into a tree of block elements; inline elements only lend their text to the
block around them. Parts that never belong to an article (menus, scripts, hidden elements) are
left out while reading. Blocks named as other parts (by element, role, class or id) are left out after it.
Names of sidebars, footers, comments, adverts, notices and the like hold unless no other text is
on the page. Names that also wrap whole articles (forms, widgets, dialogs) are a weight in the
scores where the best container lies in such a block, or takes most of its text from them, and
hold elsewhere. Inline elements are not judged by names. Every paragraph then passes points for its length and commas to its ancestors, less with distance, and a
container's points are discounted by the share of its text that is links. The best container,
or the article element around it, is kept, together with siblings that score near it or are
plain paragraphs.

Text is decoded once, white space inside a block becomes one space, blocks are joined by one
space in page order. Null or empty pages give an empty text; text outside any element counts;
unclosed elements end with their parent; repeated rows are extracted like any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their part in the tree, and words in class, id or role.

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "annotation annotation-xml audio button canvas datalist head iframe map menu nav noscript object "
    "select svg template video".split()
)
PARTS = frozenset("aside dialog fieldset footer form".split())
RAW_TEXT = frozenset("script style textarea title xmp noembed noframes".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
UNLIKELY = (
    "ad ads adv advert adverts advertisement advertising adslot adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices outbrain "
    "overlay pagination pager popup promo promoted promotion recommended recommendations related replies respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets"
).split()
# Of these the ones whose parts may well be longer than the article.
FOREIGN = (
    "ad ads adv advert adverts advertisement advertising adslot adsense comment comments commentlist consent cookie cookies "
    "disqus gdpr outbrain replies respond sponsor sponsored taboola"
).split()
# Of these the ones that pages also wrap their article in.
WRAPPERS = "alertdialog dialog fieldset form modal overlay popup widget widgets".split()
# A name with one of these tells how the page is set up, as in has-sidebar or menu-open.
SETTINGS = "has with no without open opened closed enabled disabled".split()
LIKELY = "article body content entry main post story text".split()
CLOSED_BY = {
    "li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"),
    "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",),
}

# End of the fixed values.

LEAST_PARAGRAPH = 25
SIBLING_SHARE = 0.2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[\W_]+")
_PARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_HEADING = re.compile("h[1-6]")
_UNLIKELY, _LIKELY, _FOREIGN, _SETTINGS, _WRAPPERS = map(frozenset, (UNLIKELY, LIKELY, FOREIGN, SETTINGS, WRAPPERS))
_STRONG = (_UNLIKELY | ROLES | PARTS) - _WRAPPERS
_SOLID = BLOCKS | LEFT_OUT
_NONE: frozenset[str] = frozenset()


class Block:
    __slots__ = ("tag", "parent", "content", "likely", "length", "commas", "linked", "own_length", "own_commas", "own_linked", "score", "doubts")

    def __init__(self, tag: str, parent: Block | None, likely: int, doubts: frozenset[str] = _NONE):
        self.tag, self.parent, self.likely, self.doubts = tag, parent, likely, doubts
        self.content: list[str | Block] = []
        self.own_length = self.own_commas = self.own_linked = self.length = self.commas = self.linked = 0
        self.score = 0.0


def _names(value: str) -> list[set[str]]:
    """The words of each name in a class or id, whole and split at capitals, without names of settings."""
    names = []
    for name in value.split():
        found: set[str] = set()
        for part in _SPLIT.split(name):
            found.add(part.lower())
            found.update(p.lower() for p in _PARTS.split(part))
        if not found & _SETTINGS:
            names.append(found)
    return names


def _judge(tag: str, attributes: str) -> tuple[bool, int, frozenset[str]]:
    """Whether the element is left out, what its names speak for (1, 0, -1), and the words that
    speak for another part than the article."""
    if tag in LEFT_OUT:
        return True, -1, _NONE
    doubts = {tag} if tag in PARTS else set()
    if not attributes or tag in ("html", "body"):
        return False, -len(doubts), frozenset(doubts)
    block = tag in BLOCKS
    if not block and not _MAY_HIDE.search(attributes):
        return False, 0, _NONE
    names: list[set[str]] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NOT_SHOWN.search(value):
            return True, -1, _NONE
        if not block:
            continue
        if name == "role":
            doubts |= ROLES & {value.strip().lower()}
        elif name in ("class", "id"):
            names += _names(value)
    unlikely = _UNLIKELY.intersection(*[set().union(*names)])
    likely = any(name & _LIKELY for name in names)
    # A name of its own says that this is the article; only what others write is told from it.
    article = tag in ("article", "main") or any(name & {"article", "main"} and not name & _UNLIKELY for name in names)
    doubts |= unlikely & _FOREIGN if article else unlikely
    return False, likely - bool(unlikely or doubts), frozenset(doubts)


def _pruned(blocks: list[Block], words: frozenset[str], spared: frozenset[int] = frozenset()) -> list[Block]:
    """The blocks without those that one of the words is said of, and without what is in these."""
    gone: set[int] = set()
    for block in blocks:
        if id(block.parent) in gone or (block.doubts & words and id(block) not in spared):
            gone.add(id(block))
    if not gone:
        return blocks
    kept = [b for b in blocks if id(b) not in gone]
    for block in kept:
        block.content = [" " if isinstance(c, Block) and id(c) in gone else c for c in block.content]
    return kept


def _without_strong(blocks: list[Block]) -> list[Block]:
    """Without sidebars, footers, comments and the like, unless they hold the only text of the page: then
    those stay that hold a first heading or an article, or else all of the kind that is left."""
    inside: dict[int, tuple[bool, bool]] = {}
    rest = structure = foreign = 0
    # Text outside of any such part, in parts of the page, and in what others wrote.
    for block in blocks:
        in_part, in_foreign = inside[id(block.parent)] if block.parent is not None else (False, False)
        in_part, in_foreign = in_part or bool(block.doubts & _STRONG), in_foreign or bool(block.doubts & _FOREIGN)
        inside[id(block)] = in_part, in_foreign
        if _HEADING.fullmatch(block.tag):
            continue
        text = block.own_length - block.own_linked
        if in_foreign:
            foreign += text
        elif in_part:
            structure += text
        else:
            rest += text
    if rest >= LEAST_PARAGRAPH or rest >= max(structure, foreign):
        return _pruned(blocks, _STRONG)
    if structure < LEAST_PARAGRAPH and rest + structure:
        return _pruned(blocks, _STRONG if rest else _FOREIGN)
    strong = _FOREIGN if not rest + structure else _STRONG - _FOREIGN
    holders: set[int] = set()
    for block in blocks:
        if block.tag in ("h1", "article", "main"):
            above: Block | None = block
            while above is not None and id(above) not in holders:
                holders.add(id(above))
                above = above.parent
    # The parts that are left are judged one by one only where some of them hold a heading or an article.
    if any(id(b) in holders and b.doubts & strong for b in blocks):
        blocks = _pruned(blocks, strong, frozenset(holders))
    return blocks if strong == _FOREIGN else _pruned(blocks, _FOREIGN)


def _without_parts(blocks: list[Block]) -> list[Block]:
    if not any(b.doubts for b in blocks):
        return blocks
    blocks = _without_strong(blocks)
    if not any(b.doubts & _WRAPPERS for b in blocks):
        return blocks
    score(blocks)
    best = _best(blocks)
    spared: set[str] = set()
    above = best
    while above is not None:
        spared |= above.doubts & _WRAPPERS
        above = above.parent
    if best is not None and not spared:
        held: dict[str, int] = {}
        below: list[str | Block] = list(best.content)
        while below:
            block = below.pop()
            if isinstance(block, Block):
                words = block.doubts & _WRAPPERS
                for word in words:
                    held[word] = held.get(word, 0) + block.length
                if not words:
                    below += block.content
        spared = {word for word, length in held.items() if 2 * length > best.length}
    return _pruned(blocks, frozenset(_WRAPPERS - spared))


class _Open:
    """Open elements, and where those of each kind are, so that none is looked for."""

    def __init__(self, root: Block):
        # Tag, block its text belongs to, left out, within a link.
        self.stack: list[tuple[str, Block, bool, bool]] = [("root", root, False, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.solid: list[int] = []
        self.left_out: list[int] = []

    def push(self, tag: str, block: Block, out: bool, linked: bool) -> None:
        place = len(self.stack)
        self.stack.append((tag, block, out, linked))
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS:
            self.blocks.append(place)
        if tag in LEFT_OUT:
            self.left_out.append(place)
        if tag in _SOLID:
            self.solid.append(place)

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in LEFT_OUT:
                self.left_out.pop()
            if tag in _SOLID:
                self.solid.pop()

    def last(self, *tags: str) -> int:
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def close(self, tag: str) -> None:
        at = self.last(tag)
        # An inline element is only closed within its block.
        if at and (tag in BLOCKS or not self.blocks or at > self.blocks[-1]):
            self.pop_to(at)

    def begin(self, tag: str) -> None:
        """A block ends an open paragraph; items end the item before them."""
        if self.solid and self.stack[self.solid[-1]][0] == "p":
            self.pop_to(self.solid[-1])
        if tag in CLOSED_BY:
            same = {"dd": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            at = self.last(*same)
            if at > max(self.last(*CLOSED_BY[tag]), self.left_out[-1] if self.left_out else 0):
                self.pop_to(at)


def parse(page: str) -> list[Block]:
    """All blocks that are not left out, parents before children; the first is the root."""
    root = Block("root", None, 0)
    blocks = [root]
    opened = _Open(root)
    stack = opened.stack
    end, size = 0, len(page)

    def text(piece: str) -> None:
        _, block, out, linked = stack[-1]
        if out:
            return
        if "&" in piece:
            piece = html.unescape(piece)
        block.content.append(piece)
        trimmed = len(" ".join(piece.split()))
        block.own_length += trimmed
        block.own_commas += piece.count(",") + piece.count("، ") + piece.count("，")
        if linked:
            block.own_linked += trimmed

    while end < size:
        found = _TOKEN.search(page, end)
        if not found:
            text(page[end:])
            break
        if found.start() > end:
            text(page[end : found.start()])
        end = found.end()
        slash, tag, attributes, slash2, tag2, attributes2 = found.groups()
        tag = (tag or tag2 or "").lower()
        if not tag:
            continue
        if slash or slash2:
            opened.close(tag)
            continue
        if tag in RAW_TEXT:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, end)
            end = close.end() if close else size
            continue
        _, block, out, linked = stack[-1]
        if tag == "br":
            if not out:
                block.content.append(" ")
            continue
        if tag in BLOCKS:
            opened.begin(tag)
            _, block, out, linked = stack[-1]
        if tag in VOID:
            if tag == "hr" and not out:
                block.content.append(" ")
            continue
        attributes = attributes or attributes2 or ""
        if attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        gone, likely, doubts = (True, 0, _NONE) if out else _judge(tag, attributes)
        if tag == "header" and not gone:
            gone = not opened.last("article", "main")
        inner = block
        if tag in BLOCKS and not gone:
            inner = Block(tag, block, likely, doubts)
            block.content.append(inner)
            blocks.append(inner)
        opened.push(tag, inner, gone, linked or tag == "a")
    return _without_parts(blocks)


def score(blocks: list[Block]) -> None:
    for block in blocks:
        block.length, block.commas, block.linked = block.own_length, block.own_commas, block.own_linked
    for block in reversed(blocks):
        if block.parent is not None:
            block.parent.length += block.length
            block.parent.commas += block.commas
            block.parent.linked += block.linked
    for block in blocks:
        block.score = 25 * block.likely + {"article": 25, "main": 20, "section": 5, "div": 5, "body": 1}.get(block.tag, 0)
    for block in blocks:
        whole = block.tag in PARAGRAPHS
        length, commas = (block.length, block.commas) if whole else (block.own_length, block.own_commas)
        if length < LEAST_PARAGRAPH:
            continue
        points = 1 + commas + min(length // 100, 3)
        # A container with text of its own is its own paragraph.
        above, level = (block.parent if whole else block), 0
        while above is not None and level < 6:
            above.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above, level = above.parent, level + 1


def link_density(block: Block) -> float:
    return block.linked / block.length if block.length else 0.0


def _best(blocks: list[Block]) -> Block | None:
    held = [b for b in blocks if b.tag not in PARAGRAPHS and not _HEADING.fullmatch(b.tag) and b.length]
    return max(held, key=lambda b: b.score * (1 - link_density(b)), default=None)


def kept_blocks(blocks: list[Block]) -> list[Block]:
    """The article: the best container, or the article element around it, and fitting siblings."""
    best = _best(blocks)
    if best is None:
        return [blocks[0]]
    above = best
    while above is not None:
        if above.tag == "article":
            best = above
        above = above.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, SIBLING_SHARE * best.score * (1 - link_density(best)))
    kept = []
    for other in best.parent.content:
        if not isinstance(other, Block):
            continue
        density = link_density(other)
        plain = other.tag == "p" and (density < 0.25 if other.length > 80 else density == 0 and other.length > 0)
        if other is best or (best.tag != "article" and (plain or other.score * (1 - density) >= least)):
            kept.append(other)
    return kept


def text_of(block: Block) -> str:
    """Text of the blocks in page order, one space between them."""
    parts: list[str] = []
    waiting: list[str | Block] = [block]
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            parts.append(item)
        else:
            parts.append(" ")
            waiting.append(" ")
            waiting.extend(reversed(item.content))
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = parse(page)
    score(blocks)
    return " ".join(filter(None, map(text_of, kept_blocks(blocks))))


def _extract(rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, "text", "n_chars"]
            )

    return run


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """`(page_id, url, text, n_chars)`, one row per row of `pages`."""
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return slim.mapInArrow(_extract(["page_id", "url"]), f"{kinds}, text string, n_chars long")
