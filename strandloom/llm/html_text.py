"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand (menus,
footers, adverts, comments, ...), by link density, by length and by the share of stop words; what is short,
or long but poor in stop words, stays open. Where a text has letters of no script or language whose stop words are known, its length
and sentences stand for them. The second pass gives open blocks the label of the nearest decided blocks, those in the same section of the page first;
what has no decided block to follow must be a sentence.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .quality import COMMON_WORDS

STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words)
#: Characters from which a block is long enough to be decided by its words; shares of stop words and of linked characters.
MIN_LENGTH, GOOD_STOP_SHARE, MAX_LINK_SHARE = 70, 0.15, 0.33
#: A page with a lesser share of stop words in its running text is in a language whose stop words aren't known.
LEAST_STOP_SHARE = 0.04

# Element names of HTML.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
_SECTIONS = frozenset("article aside body button details dialog div dl fieldset figure footer form head header main menu nav ol section select table textarea ul".split())
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title noframes".split())
_NEVER = frozenset("aside button dialog fieldset footer form head menu nav select".split())
_BODY = frozenset("article main".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Words of class, id, role and the like. A name marks what is not the article if one of its parts is of the first kind and the others are of any kind.
_STRONG = frozenset(
    """ad ads advert adverts advertisement advertisements advertising advertorial adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies copyright dfp disqus footer gdpr
    hidden login masthead menu modal nav navbar navigation newsletter outbrain overlay pager pagination paywall popup promo promos promoted promotion promotions recommended recommendation recommendations related replies reply
    respond share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola toast toolbar topbar trending widget widgets""".split()
)
#: Of the second kind: outside articles they mark, too; inside they may be part of what is told.
_WEAK = frozenset("alert aside billboard complementary disclaimer header legal notice notices privacy search warning".split())
#: Of the third kind, which mark nothing: what a part looks like, where it stands and what holds it.
_PLAIN = frozenset(
    """area article articles bar block body bottom box btn button buttons card cards col column container content contents count counts desktop div entry feed fixed floating footers form global group head heading hide icon icons inline
    inner item items label large latest left link links list main medium mobile module more outer page panel popular post posts primary region right row secondary section sections show site slot small sticky stories story tag tags text thread
    title titles toggle tools top unit wrap wrapper""".split()
)
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: Words of a class that only tell what a part has or how it looks.
_LOOKS = re.compile(r"(?:has|with|without|no|not|is|overflow|js|layout)[-_]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][\w:.@-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|</?\Z""", re.S)
_SPACE = re.compile(r"\s+")
_OWN_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|\ball rights reserved\b|\bcopyright\b", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    section: int  # number of the innermost article or main, else of the innermost sectioning element
    outside: bool  # stands in a part of the page that is never the article
    article: bool  # stands in an article or main element
    label: str = field(default="open")


#: Elements that end where another of their kind, or of the kinds with them, begins.
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text, in order, with where they stand."""
    page = page or ""
    out: list[Block] = []
    # open elements that say where their text stands: name, number, outside, number of the article or main they stand in
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
    made = link_depth = 0
    dropped: list[str] = []  # elements inside a block that are open and say that they aren't the article, and those in them
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", "".join(t for t, _ in parts)).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", t).strip()) for t, inside in parts if inside)
                _, number, outside, article = stack[-1]
                out.append(Block(text, linked, article or number, outside, bool(article)))
            parts.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if (upto := m.start() if m else end) > at and not dropped:
            parts.append((html.unescape(page[at:upto]), link_depth > 0))
        if not m:
            break
        token, at = m[0], m.end()
        if token[1:2] in "!?" or token in ("<", "</"):
            continue
        closing = token[1] == "/"
        name = re.match(r"</?([a-zA-Z][^\s/>]*)", token)[1].lower()
        if not closing and name in _RAW and not token.endswith("/>"):
            stop = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            if name in _BLOCK:
                flush()
            continue
        if name == "br":
            parts.append((" ", False))
        elif name == "a":
            link_depth = 0 if closing else 1
        if name not in _BLOCK:
            # text inside of a block: left out while an element that isn't the article is open, or until the block ends
            if closing and name in dropped:
                del dropped[len(dropped) - 1 - dropped[::-1].index(name) :]
            elif not closing and name not in _VOID and not token.endswith("/>") and (dropped or "=" in token and _marked(token, name, bool(stack[-1][3]))):
                dropped.append(name)
            continue
        flush()
        dropped.clear()
        if name in _VOID:
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                del stack[depth:]
                link_depth = 0
            continue
        # a paragraph or a heading ends where another block begins, an item where the next does
        while len(stack) > 1 and (stack[-1][0] in _TEXT or name in _ENDED_BY.get(stack[-1][0], ())):
            stack.pop()
        made += 1
        _, number, outside, article = stack[-1]
        if not outside and name not in ("body", "html"):
            outside = name in _NEVER or name == "header" and not article or len(token) > len(name) + 2 and _marked(token, name, bool(article))
        if name in _SECTIONS:
            stack.append((name, made, outside, made if name in _BODY else article))
        elif outside and not stack[-1][2]:
            stack.append((name, number, outside, article))
    flush()
    return out


def _marked(token: str, name: str, in_article: bool) -> bool:
    """Whether an element's attributes say that it isn't the article."""
    for m in _ATTRIBUTE.finditer(token, len(name) + 1):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
        if key in ("class", "id", "role", "aria-label", "data-role", "data-component"):
            for word in value.split():
                kinds = None if _LOOKS.match(word.lower()) else _kinds(word, in_article)
                # an article element is only taken out as a reader's comment, not for a word in its class; an article's own header is part of it
                if kinds and (name not in _BODY or any(k.startswith(("comment", "repl")) for k in kinds)):
                    return True
    return False


def _kinds(word: str, in_article: bool) -> list[str]:
    """The parts of a name that mark what isn't the article; none if another part speaks of something else."""
    parts = [p for p in (x.lower() for x in _PARTS.split(word)) if p and not re.fullmatch(r"v?\d+|[a-z]", p)]
    marks = [p for p in parts if p in _STRONG or not in_article and p in _WEAK]
    return marks if marks and all(p in _STRONG or p in _WEAK or p in _PLAIN for p in parts) else []


_SENTENCE = re.compile(r"[.!?…。！？।؟]+[\"'»”’)\]]*(?:\s|\Z)|[。！？]")
#: Letters of scripts whose texts have no blanks between words.
_SOLID = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _long(text: str) -> bool:
    """Whether a block is long enough to be decided by itself; a letter that is about half a word counts as three."""
    return len(text) >= MIN_LENGTH or not text.isascii() and len(text) + 2 * len(_SOLID.findall(text)) >= MIN_LENGTH


def _stop_words(text: str) -> tuple[int, int]:
    """Words, and those of them that are stop words."""
    words = text.lower().split()
    return len(words), sum(w.strip(".,;:!?\"'()*#$%&|") in STOP_WORDS for w in words)


def _prose(text: str) -> bool:
    """Whether a block without known stop words reads like sentences: it has their ends, and words of usual length unless its script has no blanks."""
    if not _SENTENCE.search(text):
        return False
    words = text.split()
    return bool(_SOLID.search(text)) or len(words) >= 8 and 2 <= sum(map(len, words)) / len(words) <= 14


def _foreign(text: str) -> bool:
    """Whether most letters are of another script than the stop words'."""
    letters = [c for c in text if c.isalpha()]
    return sum(c > "\u024f" for c in letters) * 2 > len(letters)


def decide(found: list[Block]) -> None:
    """Label every block good or bad, in two passes."""
    counts = {k: _stop_words(b.text) for k, b in enumerate(found) if not b.outside and _long(b.text)}
    running = [k for k in counts if found[k].linked <= MAX_LINK_SHARE * len(found[k].text)]
    # a page whose running text has hardly any known stop words is in a language of which none are known
    unknown = sum(counts[k][1] for k in running) < LEAST_STOP_SHARE * sum(counts[k][0] for k in running)
    for k, b in enumerate(found):
        if b.outside:
            b.label = "bad"
        elif b.linked > MAX_LINK_SHARE * len(b.text) and not (b.article and len(b.text) - b.linked >= MIN_LENGTH):
            b.label = "bad"
        elif len(b.text) < 2 * MIN_LENGTH and not b.article and _OWN_NOTICE.search(b.text):
            b.label = "bad"
        elif k in counts:
            words, stops = counts[k]
            if stops >= GOOD_STOP_SHARE * words or _prose(b.text) and (unknown or _foreign(b.text)):
                b.label = "good"
    before = _nearest(range(len(found)), found)
    after = _nearest(range(len(found) - 1, -1, -1), found)
    final = []
    for k, b in enumerate(found):
        if b.label != "open":
            final.append(b.label)
            continue
        # (distance, label) of the decided blocks to either side, in the same section and then anywhere
        own = [x for x in (before[k][0], after[k][0]) if x]
        any_ = [x for x in (before[k][1], after[k][1]) if x]
        if own:
            final.append("good" if any(x[1] == "good" for x in own) else "bad")
        elif b.article:
            final.append("good")
        elif not any_ or not any(x.label == "good" for x in found):
            # nothing to follow, or only what isn't the article: a sentence may be one, a word or two may not
            final.append("good" if _SENTENCE.search(b.text) and (len(b.text.split()) >= 3 or _SOLID.search(b.text)) else "bad")
        else:
            least = min(x[0] for x in any_)
            final.append("good" if any(x == (least, "good") for x in any_) else "bad")
    for b, label in zip(found, final):
        b.label = label


def _nearest(order: range, found: list[Block]) -> dict[int, tuple]:
    """For each block, the last decided block that was met in this order: of its own section, and of any."""
    out: dict[int, tuple] = {}
    last: dict[int, tuple[int, str]] = {}
    any_: tuple[int, str] | None = None
    for k in order:
        b = found[k]
        own = last.get(b.section)
        out[k] = ((abs(k - own[0]), own[1]) if own else None, (abs(k - any_[0]), any_[1]) if any_ else None)
        if b.label != "open":
            any_ = (k, b.label)
            if not b.outside:
                last[b.section] = any_
    return out


def main_text(page: str | None) -> str:
    """The blocks labelled good, joined by two line feeds."""
    found = blocks(page)
    decide(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html, ...).

    A null, empty or blank page, or one without an article, has empty text. Unclosed and cut-off tags end
    with the page. Whole pages are read and whole articles returned, however long. Between a good and a bad neighbour that are as near, an open block
    is good. Repeated rows come back row by row; an empty table gives an empty result; other columns of pages are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(small_batches).mapInArrow(run, "page_id long, url string, text string, n_chars long")
