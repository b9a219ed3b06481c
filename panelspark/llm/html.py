"""Main text of web pages by two passes over their blocks.

Markup cuts a page into blocks. What cannot be article text by its place (menus, page headers
and footers, sidebars, notices, adverts, forms, reader comments; by element, role, or the words
of class and id) is boilerplate from the start, but stays in order as a neighbour. The first
pass labels every other block by link density, length and stop-word density as good, bad or
ambiguous. Stop words decide only if most of a page's long blocks read as a language with a list;
on other pages length and links do, for blocks that are mostly letters. In the second pass ambiguous blocks, short ones and headings above all, take the
label of the nearest decided neighbour. If a page marks its article, that is where good blocks
are looked for; of a main part with an article in it, in the article, if that is most of it.

Inside an article, and for sections anywhere, a name marks boilerplate only if all of it does
("related-posts", not "related-work"), and a paragraph's name only if it is an advert's. Comments
stay boilerplate if they are written as articles themselves.

Rules: null html is an empty page. Scripts, styles, comments and the head hold no text.
Character references are decoded, white space inside a block becomes one space, and good
blocks are joined by line feeds. A page without good blocks has the empty text. Repeated rows
are extracted as often as they come.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_rows

#: Function words of some languages, those of langid's families among them (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was with as are be this by at from or an not which have "
    "der die das und zu den von mit dem des ein eine nicht ist auf für sich auch als an im "
    "le la les de des du et en un une est que qui dans pour par sur au avec pas ce il elle "
    "el los las y del se por con una su para no al lo como más o pero sus "
    "di che è il per non sono della dei gli het een van niet zijn met voor os as um uma não com do da "
    "och att det som är på av för till ett inte han hon den har med från var de kan om så sig vid eller "
    "og i er til ikke jeg vi blev fra men også blir ble etter hadde når være skal ved å af efter havde "
    "að sem var við ekki hann hún það því þegar eru ég en af um úr hefur þeir frá "
    "și în este sunt cu pe la din care nu mai fost sau dar după prin fi au lui ce ale "
    "amb els dels però també són aquest aquesta més hi ha fins seva va ser per als "
    "и в во не на что он она с со как это по но из у за от о же для его их был была было были также при которые "
    "і й що як це та але від до про його її були був була є під або між після яка який які "
    "w z się nie jest że od przez dla są było był była jak oraz ale po już tym tego który która które ich "
    "v ve že s se je jsou byl byla bylo jako pro které který která ale od po při k ze si aby také "
    "sa že bol bola bolo ako pre ktoré ktorý ktorá od pri alebo aj sú nie už zo "
    "е са се да за от със към като който която които беше бяха но или след при ще "
    "је су се да у на од за као који која које али није био била било са из и након "
    "su je u na od za kao koji koja koje ali nije bio bila bilo iz te ili nakon što kako još "
    "in je so na za pri od kot ki pa ali ni bil bila bilo iz tudi ter da še po lahko".split()
)
#: Blocks shorter than this are ambiguous, longer ones can be good by themselves.
SHORT, LONG = 70, 140
#: Shares of a block's words that are stop words: some, and as in running text.
SOME_STOPS, MANY_STOPS = 0.15, 0.25
LINK_SHARE = 0.5
#: Share of the long blocks' characters that is in listed languages, if stop words decide.
LISTED_SHARE = 0.5
#: From here on characters are mostly syllables or words and stand for so many letters.
WIDE, LETTERS = "\u2e80", 3

#: One piece of markup. Quotes only count after an equals sign; nothing is tried twice.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text at all.
_RAW = frozenset(
    "script style noscript template svg annotation annotation-xml iframe canvas head title textarea xmp".split()
)
#: Elements that begin and end blocks.
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary dialog hr "
    "center select option optgroup menu hgroup".split()
)
#: Elements whose nesting matters.
_NESTED = frozenset(
    "main article section div ul ol dl table figure header footer nav aside form fieldset details dialog select menu "
    "button label blockquote p span li hgroup".split()
)
_CLOSED_BY_BLOCK = frozenset(("p", "span"))
_BOILER_ELEMENTS = frozenset("nav aside footer form select menu button dialog fieldset label".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words of class and id that mark boilerplate.
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notification newsletter subscribe subscription "
    "signup login popup modal overlay comment comments disqus respond reply replies share sharing social related recommended "
    "widget toolbar pagination pager copyright disclaimer skip search alert".split()
)
#: Those of adverts, and words that may stand beside one of them in a name that means boilerplate.
_ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
_PLAIN_WORDS = frozenset(
    "area article articles bar block box button buttons card cards container content form group inline item items link links "
    "list module post posts section slot stories story tools unit wrap wrapper".split()
)
#: Names of what holds readers' comments, whole.
_COMMENTS = re.compile(
    r"(?:comments?|responses?|replies|reply|respond|disqus)(?:[-_]?(?:area|block|body|box|content|container|form|list|main|"
    r"section|thread|wrap|wrapper|item|[0-9]+))*",
    re.I,
)
_HEAD_WORDS = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NO, _BY_NAME, _BY_ELEMENT = 0, 1, 2


class _Block:
    __slots__ = ("article", "boiler", "heading", "label", "linked", "main", "text")

    def __init__(self, text: str, linked: int, main: bool, article: bool, boiler: bool, heading: bool):
        self.text, self.linked, self.main, self.boiler, self.heading = text, linked, main, boiler, heading
        self.article, self.label = article, ""


class _Open:
    """An open element and what holds inside it."""

    __slots__ = ("article", "boiler", "head", "main", "name")

    def __init__(self, name: str, boiler: int, main: bool, head: bool, article: bool):
        self.name, self.boiler, self.main, self.head, self.article = name, boiler, main, head, article


def _words(name: str) -> set[str]:
    return {w.lower() for w in _NAME_WORD.findall(name)}


def _named_boiler(name: str, names: str, inside: bool) -> bool:
    """Whether class and id mark an element as boilerplate; ``inside``: in an article."""
    if name == "p" and inside:
        return bool(_words(names) & _ADVERT_WORDS)
    if not inside and name != "section":
        return bool(_words(names) & _BOILER_WORDS)
    each = (_words(n) for n in names.split())
    return any(words & _BOILER_WORDS and words <= _BOILER_WORDS | _PLAIN_WORDS for words in each)


def _opened(name: str, rest: str, outer: _Open) -> _Open:
    boiler, main, head = outer.boiler, outer.main, outer.head
    whole, article = name in ("article", "main"), outer.article or name == "article"
    if name in _BOILER_ELEMENTS:
        boiler = _BY_ELEMENT
    elif name == "header":
        head = True
    if rest and not rest.isspace() and rest != "/":
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
        role = given.get("role", "").lower()
        whole |= role == "main"
        hidden = "hidden" in given or given.get("aria-hidden") == "true"
        hidden |= "display:none" in given.get("style", "").replace(" ", "").lower()
        names = given.get("class", "") + " " + given.get("id", "")
        if role in _BOILER_ROLES or hidden:
            boiler = _BY_ELEMENT
        elif any(_COMMENTS.fullmatch(n) for n in names.split()):
            # What readers wrote is no article, whatever element it is in.
            boiler = _BY_ELEMENT
        elif not whole:
            if not boiler and _named_boiler(name, names, outer.main):
                boiler = _BY_NAME
            head |= bool(_words(names) & _HEAD_WORDS) and name != "h1"
    if whole:
        main, head = True, False
        # A wrapper named after a sidebar beside the article does not make it boilerplate.
        boiler = _NO if boiler == _BY_NAME else boiler
    return _Open(name, boiler, main, head, article)


def _joined(texts: list[str]) -> str:
    """Pieces of source text as they are read: references decoded, white space as one space."""
    return " ".join(html.unescape("".join(texts)).split())


def blocks(page: str) -> list[_Block]:
    """The page's blocks in order."""
    found: list[_Block] = []
    stack = [_Open("", _NO, False, False, False)]
    texts: list[str] = []
    linked: list[list[str]] = []
    links = breaks = 0
    heading = False
    here, end_of_page = 0, len(page)

    def close() -> None:
        nonlocal breaks
        breaks = 0
        if texts:
            text = _joined(texts)
            texts.clear()
            if text:
                inner = stack[-1]
                # In an article's own header only the headline is article text.
                boiler = inner.boiler or inner.head and not (inner.main and heading)
                size = sum(len(_joined(x)) for x in linked)
                found.append(_Block(text, size, inner.main, inner.article, bool(boiler), heading))
        # A link that goes on in the next block is a piece of its own there.
        linked[:] = [[]]

    while here < end_of_page:
        match = _MARKUP.search(page, here)
        if match is None:
            texts.append(page[here:])
            break
        if match.start() > here:
            texts.append(page[here : match.start()])
            if links:
                linked[-1].append(texts[-1])
            if breaks and not texts[-1].isspace():
                breaks = 0
        here = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name in _BLOCK:
                close()
                heading = False
            if name == "a":
                links = 0
            if name in _NESTED:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        break
            continue
        if name in _RAW:
            if not match["rest"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, here)
                # A head that is never closed must not swallow the page.
                if end is not None:
                    here = end.end()
                elif name != "head":
                    here = end_of_page
            continue
        if name == "br":
            texts.append(" ")
            breaks += 1
            if breaks == 2:
                close()
            continue
        if name in _BLOCK:
            close()
            heading = name in _HEADINGS
            links = 0
            while stack[-1].name in _CLOSED_BY_BLOCK:
                stack.pop()
        if name == "a":
            links = 1
            linked.append([])
        if name in _NESTED and not match["rest"].endswith("/"):
            if name in ("button", "label"):
                close()
            stack.append(_opened(name, match["rest"], stack[-1]))
    close()
    return found


def _measured(text: str) -> tuple[int, float]:
    """A text's length in letters, and the share of its words that are stop words."""
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?()") in STOP_WORDS for w in words) / len(words)
    return len(text) + (LETTERS - 1) * (not text.isascii() and sum(c >= WIDE for c in text)), stops


def _lettered(text: str) -> bool:
    """Whether most characters are letters, or marks on them."""
    return 2 * sum(c.isalpha() or c >= "\u0300" for c in text) > len(text) - text.count(" ")


def label(found: list[_Block]) -> None:
    """Both passes: every block becomes ``good`` or ``bad``."""
    main = [b for b in found if b.main and not b.boiler]
    inside = sum(len(b.text) for b in main if b.article)
    if 2 * inside >= sum(len(b.text) for b in main):
        # The article is the text; of the rest of the main part only a headline above it counts.
        first = next((i for i, b in enumerate(found) if b.article and not b.boiler), 0)
        for i, block in enumerate(found):
            block.main = block.main and (block.article or block.heading and i < first)
    marked = bool(main)
    measured = [_measured(b.text) for b in found]
    free = [
        m for b, m in zip(found, measured) if not b.boiler and b.linked <= LINK_SHARE * len(b.text) and m[0] >= LONG
    ]
    listed = sum(size for size, stops in free if stops >= SOME_STOPS) >= LISTED_SHARE * sum(size for size, _ in free)
    for block, (size, stops) in zip(found, measured):
        if block.boiler or marked and not block.main:
            block.label = "bad"
        elif block.linked > LINK_SHARE * len(block.text):
            block.label = "bad"
        elif block.heading:
            block.label = ""
        elif block.main:
            block.label = "good" if size >= SHORT or stops >= SOME_STOPS else ""
        elif size < SHORT:
            block.label = ""
        elif stops >= MANY_STOPS or size >= LONG and (stops >= SOME_STOPS or not listed and _lettered(block.text)):
            block.label = "good"
        else:
            block.label = "bad" if stops < SOME_STOPS and size >= LONG else ""
    # Inside an article only its own text decides, not an advert between two paragraphs.
    decided = [i for i, b in enumerate(found) if b.label and not (marked and (b.boiler or not b.main))]
    known = {i: found[i].label for i in decided}
    before, after = -1, 0
    for i, block in enumerate(found):
        if block.label:
            before = i if i in known else before
            continue
        while after < len(decided) and decided[after] < i:
            after += 1
        up = known[before] if before >= 0 else None
        down = known[decided[after]] if after < len(decided) else None
        if up == down:
            block.label = up or ("good" if block.main else "bad")
        elif block.heading and down:
            # A heading belongs to what it stands above.
            block.label = down
        elif up is None or down is None:
            block.label = "good" if block.main else up or down
        elif i - before != decided[after] - i:
            block.label = up if i - before < decided[after] - i else down
        else:
            block.label = "good" if block.main else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    label(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"

    def one(page_id, url, page):
        text = main_text(page)
        return page_id, url, text, len(text)

    return map_rows(pages.select("page_id", F.col("url").cast("string"), "html"), schema, lambda: one)
