"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by stop-word density, length, link density and the elements around them; the second gives
short and unclear blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import map_texts

SHORT = 70  # characters; shorter blocks are ambiguous
LINKS = 0.5  # share of characters in links from which a block is a menu
DENSE = 0.25  # share of stop words from which a longer block is text
SPARSE = 0.08  # below which a longer block outside an article is none

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which one you
were her all she there would their we him been has when who will more no if out so said what up its about into than them
can only other new some could time these two may then do first any my now such like our over even most after also
le la les des du de un une et est en que qui dans pour pas sur au avec ce il elle ne se par plus son sa ses ou mais nous
vous je on aux cette sont comme leur tout fait
der die das und ist ein eine einer einen dem den von zu mit sich auf für nicht als auch es an werden aus er hat dass sie
nach wird bei noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
el los las del y una con para por se su al lo como más pero sus ya este sí porque esta entre cuando muy sin sobre ser
también hasta hay donde quien desde todo nos
""".split())

# Elements by what they mean for their text.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|select|title"
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th
thead tr ul
""".split())
ASIDE = frozenset("nav footer aside form menu dialog button head search".split())
MAIN = frozenset("article main".split())
GROUPS = frozenset("article body center div fieldset main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in a class, id or role that mark what is no part of the article.
HINTS = frozenset("""
ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices alert popup modal overlay newsletter subscribe subscription signup login search nav navbar navigation menu breadcrumb
breadcrumbs pagination pager sidebar aside complementary contentinfo footer masthead topbar toolbar share sharing social related
recommended recommendations widget comment comments commentlist respond reply replies disqus form dialog
""".split())

# Words beside a hint that do not change what it says.
PLACES = frozenset("""
site main page global primary secondary top bottom left right center inner outer box block list item items wrap wrapper container
area section content bar panel header links buttons icons unit slot
""".split())
_OUTSIDE = (False, 0, 0, False)  # aside, article, group, doubted: outside of all elements

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<[!?/][^>]*>"
    r"|</?[a-z][^>]*>",
    re.I | re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    aside: bool  # in an element that is no part of an article
    main: int  # number of the article or main element around it, 0 for none
    group: int  # number of the innermost element around it that groups blocks, 0 for none
    doubted: bool  # in an element whose name holds a word that hints at no article, among others


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. White space inside a block is one space; character references are decoded."""
    out: list[Block] = []
    opened: list[tuple] = []  # element, aside, number of the article, of the group, doubted
    names: Counter[str] = Counter()  # of the open elements
    parts: list[str] = []
    links: list[str] = []
    in_link, articles, groups, at = False, 0, 0, 0
    aside, main, group, doubted = now = _OUTSIDE

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            linked = len(" ".join(html.unescape("".join(links)).split()))
            out.append(Block(text, linked, aside, main, group, doubted))
        parts.clear()
        links.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            links.append(text)

    # Behind the last > no tag ends. Up to it every < that may begin one is taken with the next > at the latest, so
    # the page is read in time linear in its length, whatever is left open in it.
    stop = page.rfind(">") + 1
    for token in _TOKEN.finditer(page, 0, stop):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        if at == stop and _left_open(token):
            at = len(page)
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link = not token["end"]
        elif name == "br":
            add(" ")
        if name not in BLOCKS and name not in ASIDE:
            if token["end"] or name in VOID or not any(_marks(name, token["rest"])):
                if token["end"]:
                    aside, main, group, doubted = now = _pop(opened, names, name, now, close_block)
                continue
        close_block()
        in_link = False
        if token["end"]:
            aside, main, group, doubted = now = _pop(opened, names, name, now, close_block)
        elif name not in VOID:
            if name == "p" and opened and opened[-1][0] == "p":
                opened.pop()
                names["p"] -= 1
                aside, main, group, doubted = opened[-1][1:] if opened else _OUTSIDE
            if name in MAIN and not main:
                articles += 1
                main = articles
            vetoed, hinted = _marks(name, token["rest"])
            aside = aside or name in ASIDE or (name == "header" and not main) or vetoed
            doubted = doubted or hinted
            if name in GROUPS:
                groups += 1
                group = groups
            now = (aside, main, group, doubted)
            opened.append((name, *now))
            names[name] += 1
    add(page[at:])
    close_block()
    return out


def _left_open(token: re.Match) -> bool:
    """Whether a comment or an element without markup goes on behind the token, as nothing ends it."""
    if token["raw"]:
        return re.search(rf"</{token['raw']}\s*>\Z", token[0], re.I) is None
    return token[0].startswith("<!--") and not token[0].endswith("-->")


def _pop(opened: list, names: Counter, name: str, now: tuple, close_block) -> tuple:
    """Close the innermost element of that name and what is open in it; an end without a start changes nothing."""
    if not names[name]:
        return now
    close_block()
    while True:
        last = opened.pop()[0]
        names[last] -= 1
        if last == name:
            return opened[-1][1:] if opened else _OUTSIDE


def _marks(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is no part of the article (vetoed), and whether a word in its names hints at that.

    Vetoed are hidden elements, and those with a class, id or role all of whose words are hints or say where or how
    large the element is ("cookie-notice", "site-footer"). Another name with such a word in it ("social-history") only
    raises a doubt.
    """
    if not rest or name in ("html", "body", *MAIN):
        return False, False
    if _HIDDEN.search(rest):
        return True, False
    words = [set(_PARTS.findall(n)) for m in _NAMED.finditer(rest) for n in "".join(m.groups("")).lower().split()]
    hinted = [w for w in words if w & HINTS]
    return any(w <= HINTS | PLACES for w in hinted), bool(hinted)


def stop_share(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block, has_main: bool) -> bool | None:
    """True for text, False for none, None where the block alone does not tell."""
    if block.aside or (has_main and not block.main):
        return False
    if block.linked > LINKS * len(block.text):
        return None if block.main and len(block.text) < SHORT else False
    if len(block.text) < SHORT:
        return False if block.doubted else None
    share = stop_share(block.text)
    if share >= DENSE:
        return True
    if block.doubted:
        return False
    return False if share < SPARSE and not block.main else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Unclear blocks take the label of the nearest decided neighbour in their group of blocks, else in their article.

    At equal distance text wins. An article without decided blocks is text. Outside articles and without a neighbour in
    the group, the nearest decided block of the page counts, its ends count as no text, and no text wins.
    """
    own = _nearest([(b.main, b.group, b.aside) for b in blocks], labels)
    article = _nearest([(b.main, b.aside) for b in blocks], labels)
    page = _nearest([0] * len(blocks), labels)
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = own[i] or (article[i] if blocks[i].main else [])
            if near:
                label = max(near)[1]
            elif blocks[i].main:
                label = True
            else:
                ends = [(-i - 1, False), (i - len(blocks), False)]
                label = max(page[i] + ends, key=lambda x: (x[0], not x[1]))[1]
        out.append(label)
    return out


def _nearest(scopes: list, labels: list[bool | None]) -> list[list[tuple[int, bool]]]:
    """For each block, (minus the distance, label) of the decided ones before and after it with the same scope."""
    out: list[list[tuple[int, bool]]] = [[] for _ in labels]
    for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
        last: dict = {}
        for i in order:
            if labels[i] is not None:
                last[scopes[i]] = i
            elif scopes[i] in last:
                j = last[scopes[i]]
                out[i].append((-abs(i - j), labels[j]))
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    has_main = any(b.main and not b.aside for b in blocks)
    labels = second_pass(blocks, [first_pass(b, has_main) for b in blocks])
    return "\n\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    The text is the kept blocks in page order, joined by an empty line; a NULL or empty page, or one without text, has
    an empty text. Rows are independent of each other; repeated rows stay.
    """
    key = F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = pages.select(key.alias("key"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("data"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def step(keys, data):
        out = [main_text(d.decode()) for d in data]
        columns = [[k["page_id"] for k in keys], [k["url"] for k in keys], out, [len(t) for t in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return map_texts(rows, step, "page_id long, url string, text string, n_chars long")
