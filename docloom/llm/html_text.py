"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at its block-level tags.  The first pass decides each block from its stop-word
density, length and link density, and from what encloses it (menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are out; article and main speak for a block).  Short or middling blocks
stay open; in the second pass they take the label of the nearest decided neighbours in the same container.
Pages in whose blocks stop words are rare are in another language: there length and links alone decide.

Reading takes time in proportion to the page; broken markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH, STOPS_NONE = 0.2, 0.3, 0.08
LINKS_HIGH, LINKS_IN_ARTICLE = 0.35, 0.8

# HTML tag names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside details dialog div dl fieldset figure footer form header main menu nav ol section table td tr ul".split())
OUT_TAGS = frozenset("nav footer aside form menu button select dialog".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select button head".split())
# Words in class, id and role that name what is not the article.
OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies copyright disclaimer disqus footer masthead menu modal nav navbar navigation newsletter notice pager"
    " pagination popup promo promotion related replies search share sharing sidebar signup social sponsor sponsored"
    " subscribe toolbar widget".split()
)
#: Words that, alone, name the article itself, and words that say something about what they stand with.
KEPT_WORDS = frozenset("article body content entry main page post story text".split())
ABOUT_WORDS = frozenset("disabled enabled has hide is no not off on show with without".split())
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
# HTML tags of running text, and tags that hold nothing.
TEXT_TAGS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 p pre summary".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i"
    " if in into is it its just like more most my no not of on one only or other our out over said she so some than that the"
    " their them then there these they this to two up was we were what when which who will with would you your"
    " aber als am auch auf aus bei bin bis da das dass dem den der des die doch du ein eine einem einen einer er es für hat"
    " ich ihr im ist kann man mehr mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn"
    " werden wie wir wird zu zum zur"
    " au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où"
    " par pas plus pour qu que qui sa se ses son sont sur un une vous y"
    " al como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hasta hay la las le lo los más me mi"
    " muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una y ya".split()
)

_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_CUT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    text: str
    link_chars: int
    out: bool  # inside an element that is no part of the article
    group: int  # nearest enclosing article or main, 0: none
    heading: bool
    tag: str = "p"
    label: str = ""


def _names_furniture(attributes: str, whole: bool) -> bool:
    """Whether class, id or role say that an element is no part of the article.

    A name that is one of OUT_WORDS says so; else one that is one of KEPT_WORDS says the contrary; else a name
    of several parts says so if one of them is, and none only qualifies the others (has-sidebar).
    whole: of such names only the last part counts, or the first of one about readers' comments."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split()
    if any(n in OUT_WORDS for n in names):
        return True
    if any(n in KEPT_WORDS for n in names):
        return False
    for parts in map(_CUT.split, names):
        if not ABOUT_WORDS.isdisjoint(parts):
            continue
        if not OUT_WORDS.isdisjoint([parts[-1], *(p for p in parts[:1] if p in COMMENT_WORDS)] if whole else parts):
            return True
    return False


def _is_out(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OUT_TAGS or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if tag in ("body", "main", "html"):
        return False
    return _names_furniture(attributes, whole=tag == "article")


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order.  Character references are decoded, white space is one space."""
    page = page or ""
    found: list[Block] = []
    parts: list[str] = []
    link_chars = in_link = breaks = 0
    stack: list[tuple[str, bool, int]] = []  # tag, out, group of each open block
    hidden: list[str] = []  # open inline elements from a hidden one on
    unclosed: set[str] = set()
    group = groups = 0
    heading, own_tag = False, "p"

    def text(raw: str) -> None:
        nonlocal link_chars, breaks
        if raw and not hidden:
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if raw.strip():
                breaks = 0
                if in_link:
                    link_chars += len(" ".join(parts[-1].split()))

    def close() -> None:
        nonlocal link_chars, breaks
        if parts and (joined := " ".join("".join(parts).split())):
            found.append(Block(joined, link_chars, any(s[1] for s in stack), group, heading, own_tag))
        parts.clear()
        link_chars = breaks = 0

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            text(page[at:] if start < 0 else page[at:start])
            if start >= 0 and not _NAME.match(page, start):
                text(page[start:])
            break
        text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1
            continue
        m = _NAME.match(page, start)
        if not m:
            text("<")
            at = start + 1
            continue
        tag = m.group(1).lower()
        rest = _REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        attributes, at = page[m.end() : end - 1], end
        closing = page[start + 1] == "/"
        if tag in RAW_TAGS and not closing:
            if (not attributes.endswith("/") or tag in ("script", "style")) and tag not in unclosed:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s>/])[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = size
                else:
                    unclosed.add(tag)  # read on behind the tag
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                close()
            continue
        if tag not in BLOCK_TAGS:
            if tag == "a":
                in_link = 0 if closing else 1
            if closing and hidden:
                if tag in hidden:
                    del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
            elif not closing and tag not in VOID_TAGS and not attributes.endswith("/") and (hidden or attributes and _HIDDEN.search(attributes)):
                if len(hidden) < 50 or tag == hidden[-1]:
                    hidden.append(tag)
            continue
        close()
        hidden.clear()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        own_tag = tag if not closing else stack[-1][0] if stack else "p"
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in CONTAINERS and stack[k][0] in CONTAINERS:
                    break
        else:
            if tag in ("article", "main"):
                stack = [s for s in stack if not (s[0] in ("nav", "header") and s[1])]
                groups += 1
            while stack and stack[-1][0] not in CONTAINERS:  # p, li and the like end where the next block begins
                if tag in CONTAINERS and stack[-1][0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    break
                stack.pop()
            own = groups if tag in ("article", "main") else stack[-1][2] if stack else 0
            stack.append((tag, _is_out(tag, attributes, bool(stack and stack[-1][2])), own))
        group = stack[-1][2] if stack else 0
        in_link = 0
    close()
    return found


def _size(block: Block) -> int:
    """Characters; those of scripts that need fewer of them for a word count three times."""
    return len(block.text) + 2 * len(_WIDE.findall(block.text))


def _stop_share(words: list[str]) -> float:
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def other_language(found: list[Block]) -> bool:
    """Whether stop words are rare in all that may be text."""
    words = [w for b in found if not b.out and _size(b) >= SHORT for w in _WORD.findall(b.text.lower())]
    return bool(words) and _stop_share(words) < STOPS_NONE


def first_pass(block: Block, other: bool = False) -> str:
    """good, bad, or for the second pass: middling (fair by its words) or short.  other: see other_language."""
    size = _size(block)
    most = LINKS_HIGH if not block.group else 1.0 if block.tag in TEXT_TAGS else LINKS_IN_ARTICLE
    if block.out or block.link_chars > most * len(block.text):
        return "bad"
    if size < SHORT or block.heading:
        return "short"
    if other:
        return "good" if size >= 2 * SHORT else "middling"
    stops = _stop_share(_WORD.findall(block.text.lower()))
    if stops >= STOPS_HIGH and size >= LONG:
        return "good"
    if stops >= STOPS_LOW:
        return "middling"
    return "middling" if block.group else "bad"


def second_pass(found: list[Block]) -> None:
    """Labels open blocks by the nearest decided blocks before and after them in the same container.

    Both alike: that label.  Different: the nearer one for short blocks (the later one for headings and
    ties), good for middling ones.  None decided: good inside article or main, or if middling."""
    other = other_language(found)
    first = [first_pass(b, other) for b in found]
    n = len(found)
    before, after = [-1] * n, [-1] * n
    seen: dict[int, int] = {}
    for i in range(n):
        before[i] = seen.get(found[i].group, -1)
        if first[i] in ("good", "bad") and not (found[i].out and found[i].group):
            seen[found[i].group] = i
    seen = {}
    for i in range(n - 1, -1, -1):
        after[i] = seen.get(found[i].group, -1)
        if first[i] in ("good", "bad") and not (found[i].out and found[i].group):
            seen[found[i].group] = i
    for i, block in enumerate(found):
        block.label = first[i]
        if first[i] in ("good", "bad"):
            continue
        near = [first[k] for k in (before[i], after[i]) if k >= 0]
        if not near:
            block.label = "good" if block.group or first[i] == "middling" else "bad"
        elif len(set(near)) == 1:
            block.label = near[0] if not block.group or near[0] == "good" else "good" if first[i] == "middling" else near[0]
        elif first[i] == "middling":
            block.label = "good"
        elif block.heading:
            block.label = first[after[i]]
        else:
            block.label = first[before[i]] if i - before[i] < after[i] - i else first[after[i]]


def main_text(page: str | None) -> str:
    """Good blocks joined by an empty line; empty if there is none."""
    found = blocks(page)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text of each row.

    Null and empty pages have the empty text; pages of any length are read as a whole; repeated rows stay; an empty table gives no rows; columns of
    pages other than these are not read."""

    @F.pandas_udf("string")
    def extracted(found: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in found], dtype=object)

    return pages.select("page_id", "url", extracted(F.col(html_col)).alias("text"))
