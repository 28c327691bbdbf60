"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Pass 1 decides blocks by link density, length and the share of stop words;
short blocks, headings and middling ones stay open. Pass 2 gives each open block the label of the nearest block that pass
1 decided, of two equally near ones the following for a heading and the preceding otherwise; where none was decided, open
blocks in marked-up text are kept. A marked article (``article``, ``main``) vouches for its own blocks: in it length or
stop words are enough, and open blocks look no further than its bounds.

What is no text of the page at all is left out beforehand: menus, footers, forms and the like by their tags and roles, and
containers whose class or id names an advert, a notice, reader comments and so on (``OUTSIDE_WORDS``; a word after "has",
"no" or "with", or before "enabled", "closed" and the like, names nothing). An article clears what only a wrapper's class or
a form says; in it a class counts on paragraphs, list items and spans that it names outright ("advert", "comment-item"), on
headings never. A form around the whole of a page without an article is none. Blocks left out this way are no neighbours in
pass 2. List items that are links are no text, nor are short rows of names between slashes or bars outside of articles.

Stop words are those of eleven languages; on a page where hardly any occurs, so in another language, length and links
decide alone. A character of a script that is written without spaces counts as three.

Character references are decoded, white space in a block becomes one space, kept blocks are joined by a newline in page
order.

Defined cases: a null or empty page gives an empty text; unclosed and crossed tags are closed by what follows, closing tags
of nothing are ignored; a page that breaks off ends its last block; texts of any length are used whole; repeated rows give
a row each, null ids too; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.textio import released

# Tags and words that rule out what stands in them, tags that end a block, tags without content.
OUTSIDE_TAGS = frozenset("nav footer aside form head noscript template svg iframe object button select menu dialog canvas audio video datalist fieldset".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login menu modal nav navbar navigation newsletter notice notices notification popup promo related reply replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style textarea title xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words before which such a word names nothing.
NEGATIONS = frozenset("has have no non not with without".split())
# Words after which such a word tells a state, and words for the parts of what it names.
STATES = frozenset("enabled disabled open closed allowed off on free ready aware hidden visible".split())
OUTRIGHT = frozenset("ad ads adv advert adverts advertisement comment comments consent cookie cookies newsletter promo replies reply sponsor sponsored".split())
PARTS = frozenset("item body text box block unit slot inner content entry row line".split())
# Frequent function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Swedish, Polish, Turkish and Russian.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was are be this by at from or an have not but they you which we he she his her "
    "der die das und ist nicht ein eine zu den von mit auf für sich des dem im es an als auch wird bei aus "
    "le la les de des du et en un une est que qui dans pour pas sur par plus au avec ce il elle ne se "
    "el los las y del por con su para como más pero sus al lo una no o si este entre ser "
    "il di che è per sono della dei delle nel alla gli anche più ma questo "
    "os da do em um uma não mais dos das foi ao pela seu sua "
    "het een van dat niet zijn voor met aan ook naar bij maar deze "
    "och att det som på är av för inte den till ett har men om "
    "w na z do się jest nie że to jak ale przez od po "
    "ve bir bu için ile da daha çok gibi olarak olan ne ama "
    "и в не на что с по это как но он из за у его для от".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

SHORT, LONG = 70, 200  # characters
LINKS_HIGH, LINKS_ONLY = 0.4, 0.9
STOPS_LOW, STOPS_HIGH = 0.15, 0.3
STOPS_FOREIGN = 0.03  # a page with a smaller share is in another language
UNSPACED = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption".split())
CLASSED = frozenset("p li dt dd blockquote".split())  # whose class counts in articles, too
SPANS = frozenset("span ins small".split())
ROW_OF_NAMES = re.compile(r"(?:\w[\w&'-]*(?: [\w&'-]+){0,2}(?: ?[/|»›·•>] ?|\Z)){3,}")
UNSTACKED = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
CLEAR, BY_NAME, BY_TAG = 0, 1, 2  # whether a container is left out, and by what
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    links: int  # characters in links
    tag: str
    outside: bool
    article: int  # number of the marked article that it stands in, or 0
    label: int = OPEN


def _names_outside(value: str) -> bool:
    for name in value.split():
        words = [w.lower() for w in NAME.findall(name)]
        for k, w in enumerate(words):
            if w in OUTSIDE_WORDS and (not k or words[k - 1] not in NEGATIONS) and (k + 1 == len(words) or words[k + 1] not in STATES):
                return True
    return False


def _outright(attributes: str) -> bool:
    """Whether a class names an advert, a comment or a notice, or a part of one."""
    for name, value in ATTRIBUTE.findall(attributes):
        for own in value.strip("\"'").split() if name.lower() == "class" else ():
            words = [w.lower() for w in NAME.findall(own)]
            if words and words[0] in OUTRIGHT and all(w in PARTS for w in words[1:]):
                return True
    return False


def _outside(tag: str, attributes: str, forms: bool = True) -> int:
    if tag in OUTSIDE_TAGS and (forms or tag != "form"):
        return BY_NAME if tag == "form" else BY_TAG
    out = CLEAR
    if not attributes or tag in ("html", "body", "article", "main"):
        return out
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if _names_outside(value):
                out = max(out, BY_NAME)
        elif name == "role":
            if value.lower() in OUTSIDE_ROLES:
                return BY_TAG
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return BY_TAG
        elif name == "hidden" or value.lower() == "true":
            return BY_TAG
    return out


class _Page:
    """Blocks of a page, made tag by tag."""

    def __init__(self, forms: bool):
        self.forms = forms  # whether forms are left out
        self.spans: list[bool] = []  # open spans, and whether they are left out
        self.muted = 0
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int]] = []  # tag, whether left out, article
        self.open: Counter = Counter()  # tags on the stack
        self.parts: list[str] = []
        self.links, self.in_link, self.tag, self.own, self.articles = 0, False, "", CLEAR, 0

    def text(self, piece: str) -> None:
        if self.muted:
            return
        self.parts.append(piece)
        if self.in_link:
            self.links += len(piece)

    def end(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, out, article = self.stack[-1] if self.stack else ("", CLEAR, 0)
                self.blocks.append(Block(text, self.links, self.tag, bool(max(out, self.own)), article))
            self.parts.clear()
        self.links, self.in_link, self.own, self.muted = 0, False, CLEAR, 0
        self.spans.clear()

    def span(self, closing: bool, attributes: str) -> None:
        if not closing:
            self.spans.append(_outright(attributes))
            self.muted += self.spans[-1]
        elif self.spans:
            self.muted -= self.spans.pop()

    def opened(self, name: str, attributes: str) -> None:
        self.end()
        self.tag = name
        if name in VOID_TAGS:
            return
        _, out, article = self.stack[-1] if self.stack else ("", CLEAR, 0)
        own = _outside(name, attributes, self.forms)
        if name in TEXT_TAGS and article and own == BY_NAME and not (name in CLASSED and _outright(attributes)):
            own = CLEAR
        if name in UNSTACKED:
            self.own = own
            return
        if name in ("article", "main"):
            out = CLEAR if out == BY_NAME else out
            if not article:
                self.articles += 1
                article = self.articles
        elif name == "header" and not article:
            own = BY_TAG
        self.stack.append((name, max(out, own), article))
        self.open[name] += 1

    def closed(self, name: str) -> None:
        self.end()
        self.tag = ""
        while self.open[name]:
            top = self.stack.pop()[0]
            self.open[top] -= 1
            if top == name:
                break


def blocks(page: str, forms: bool = True) -> list[Block]:
    out, at = _Page(forms), 0
    while at < len(page):
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            out.text(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        closing, name = bool(m.group(1) or m.group(4)), name.lower()
        if name in RAW_TAGS:
            if not closing:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else len(page)
        elif name == "a":
            out.in_link = not closing
        elif name in SPANS:
            out.span(closing, (m.group(3) if m.group(2) else m.group(6)) or "")
        elif name == "br":
            out.parts.append(" ")
        elif name in BLOCK_TAGS or name in OUTSIDE_TAGS:
            if closing:
                out.closed(name)
            else:
                out.opened(name, m.group(3) if m.group(2) else m.group(6))
    out.end()
    return out.blocks


def _weight(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(UNSPACED.findall(text))


def _stops(text: str) -> tuple[int, int]:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def first_pass(found: list[Block]) -> None:
    inside = [b for b in found if not b.outside]
    counted = [_stops(b.text) for b in inside]
    foreign = sum(s for s, _ in counted) < STOPS_FOREIGN * sum(n for _, n in counted)
    for b in found:
        b.label = BAD
    for b, (stops, words) in zip(inside, counted, strict=True):
        n, dense = _weight(b.text), b.links > LINKS_HIGH * len(b.text)
        share = STOPS_HIGH if foreign and n >= SHORT else stops / max(1, words)
        if b.article:
            linked = b.tag == "li" and (share < STOPS_LOW or b.links >= LINKS_ONLY * len(b.text))
            b.label = (BAD if linked else OPEN) if dense else GOOD if n >= SHORT or share >= STOPS_LOW else OPEN
        elif dense:
            b.label = BAD
        elif n < SHORT or b.tag in HEADINGS:
            b.label = BAD if b.links or ROW_OF_NAMES.fullmatch(b.text) else OPEN
        elif share >= STOPS_HIGH:
            b.label = GOOD if n >= LONG else OPEN
        elif share >= STOPS_LOW:
            b.label = GOOD if n >= LONG and not b.links else OPEN


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest block decided in pass 1, in an article of its own blocks; else they are
    good, but for text without any tags."""
    rest = [b for b in found if not b.outside]
    n, labels = len(rest), []
    before, after = [-1] * n, [n] * n
    for side, order, none in ((before, range(n), -1), (after, range(n - 1, -1, -1), n)):
        last = none
        for k in order:
            side[k] = last
            if rest[k].label != OPEN:
                last = k
    for k, b in enumerate(rest):
        if b.label != OPEN:
            labels.append(b.label)
            continue
        heading = b.tag in HEADINGS
        sides = [(k - before[k], heading, before[k]), (after[k] - k, not heading, after[k])]
        near = [side for side in sides if 0 <= side[2] < n and rest[side[2]].article == b.article]
        labels.append(rest[min(near)[2]].label if near else GOOD if b.article or any(x.tag for x in rest) else BAD)
    for b, label in zip(rest, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if found and all(b.outside for b in found) and re.search("<form", page, re.I):
        found = blocks(page, forms=False)
    first_pass(found)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint"
    return df.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)
