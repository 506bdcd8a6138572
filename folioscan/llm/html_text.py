"""Main text of web pages by the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive, tags and words of links negative; the weights are
log-odds of lying inside against outside the main text, counted over labelled pages. One linear scan finds the
contiguous region with the largest sum. The region then takes the edges of the page's structure: of the smallest article
or main element that holds most of its words, or else of whole blocks. Inside it, elements that are never main text
(menus, notices, adverts, forms, reader comments and the like, told by tag, class, id or role) are skipped; such an
element scores as one tag.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|svg|iframe|textarea)\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

# Elements and naming words of page furniture, and HTML's own block and void elements.
NEVER = frozenset("nav footer aside form button select option fieldset dialog menu head title datalist object embed canvas audio video map".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup sidebar side aside widget widgets related recommended recommendations trending "
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer foot topbar toolbar masthead share sharing social comment comments commentlist disqus "
    "reply replies respond discussion login search searchbox pagination pager copyright contentinfo complementary form skip".split()
)
#: Furniture words that are also topics: they tell nothing as the id of a part of an article, or on an element of its text.
TOPICS = frozenset("discussion search notice notices related recommended recommendations social login copyright cookie cookies consent form side foot menu menus alert promotion subscription map signup respond overlay banner footer aside".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre code blockquote figure figcaption table tbody thead tr td th span".split())
#: Words before a furniture word that say what a wrapper has beside it.
BESIDE = re.compile(r"(?:has|have|no|not|with|without|show|hide)(?:[-_]|(?=[A-Z]))", re.I)
HEADERS = frozenset({"header", "banner", "masthead"})
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Whether any element of a page could be told by a name, or is a form.
_TOLD = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*[\"']?[^\"'>]*?(?:" + "|".join(sorted(FURNITURE | HEADERS, key=len)) + r")|<form\b")
#: Elements whose words do not tell where a page's text lies.
MUTE = (NEVER - {"form"}) | {"a"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset({"article", "main"})
#: Whole blocks that are notices or controls wherever they stand at an end of a text without article or main.
NOTICE = re.compile(r"(?is)(?=.*\bcookies?\b)(?=.*\b(?:accept|consent|agree|policy|settings)\b).{0,400}|.{0,40}\ball rights reserved\b.{0,40}|(?:©|\(c\)|copyright\b).{0,80}|subscribe to .{0,60}newsletter.{0,40}|(?:reply|share|print|leave a comment|skip to (?:main )?content)\W*")
#: Kinds of text pieces: outside links, in a link of a paragraph, in another link.
TEXTS = ("word", "prose link", "link")


def _names(attributes: str, topics: bool = True, whole: bool = False) -> set[str]:
    """Words of class, id and role, or whole names alone; without topics, TOPICS are left out."""
    named = [name for m in _NAMED.finditer(attributes) for name in (m[1] or m[2] or m[3] or "").split() if not BESIDE.match(name)]
    words = {name.lower() for name in named} if whole else {w.lower() for name in named for w in _SPLIT.split(name) if w}
    return words if topics else words - TOPICS


def _furniture(tag: str, attributes: str, in_main: bool, exempt: bool = False) -> bool:
    """Whether the element that opens here is never main text; an exempt one is not told by its names."""
    if exempt:
        return bool(tag not in MAIN and _HIDDEN.search(attributes))
    if tag in NEVER or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names = _names(attributes, not (tag in TEXTUAL or in_main and tag in ("section", "div")), tag in TEXTUAL)
    if tag in MAIN:
        return bool(names & READERS)
    found = names & FURNITURE
    return bool(found - HEADERS or found and not in_main or "header" in names and not in_main or _HIDDEN.search(attributes))


def wrappers(tokens: list[re.Match], length: int) -> frozenset[int]:
    """Places of the start tags, among a page's tokens, whose names do not count (nor that it is a form), as the element holds the page's largest
    article or main, or, where there is none, more than half of the words outside links and is not told as readers'
    comments."""
    stack: list[tuple[str, int, int, bool, bool]] = []  # tag, place, words before, whether named, whether of readers
    found: list[tuple[int, int, int, bool]] = []  # place, end, words, whether of readers
    mains: list[tuple[int, int, int]] = []
    words = mute = 0

    def close(at: int, end: int) -> None:
        nonlocal mute
        for tag, place, before, named, readers in stack[at:]:
            mute -= tag in MUTE
            if named:
                found.append((place, end, words - before, readers))
            if tag in MAIN and not readers:
                mains.append((words - before, place, end))
        del stack[at:]

    for m in tokens:
        tag = m[3]
        if tag is None:
            if not mute and (m[0][0] != "<" or m[0] == "<"):
                words += len(m[0].split())
            continue
        tag = tag.lower()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if at >= 0:
                close(at, m.start())
        elif tag not in VOID and not (m[4].endswith("/") and tag not in BLOCKS):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a") and stack and stack[-1][0] == tag:
                close(len(stack) - 1, m.start())
            mute += tag in MUTE
            names = _names(m[4]) if m[4] else frozenset()
            stack.append((tag, m.start(), words, tag == "form" or bool(names & (FURNITURE | HEADERS)), bool(names & READERS)))
    close(0, length)
    if mains:
        _, at, end = max(mains, key=lambda x: (x[0], -x[1]))
        return frozenset(a for a, b, _, _ in found if a <= at and end <= b)
    return frozenset(a for a, _, n, readers in found if 2 * n > words and not readers)


def items(page: str) -> Iterator[tuple[str, str, bool]]:
    """(class, text, skipped) of the page's pieces in order. Text pieces are one of TEXTS, tags "<p", "</p" and so on
    ("<a p", "</a p" for links of a paragraph). An element of furniture gives one "<!" with its tag as the text, and its
    pieces are skipped. Comments and scripts give nothing. Behind the last piece "</article" and "</main" follow for
    those that are open."""
    stack: list[tuple[str, bool]] = []  # open elements: tag, whether it starts furniture
    depth = links = main = 0
    prose = False  # whether the open link is a paragraph's
    tokens = list(_TOKEN.finditer(page))
    exempt = wrappers(tokens, len(page)) if _TOLD.search(page) else frozenset()
    for m in tokens:
        tag = m[3]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                yield (TEXTS[1 if prose else 2] if links else "word"), piece, depth > 0
            continue
        tag = tag.lower()
        if m[2]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if at < 0 or depth and not any(s for _, s in stack[at:]) and any(s and t != tag for t, s in stack[at + 1 :]):
                continue
            closed = stack[at:]
            inside = depth
            del stack[at:]
            depth -= sum(s for _, s in closed)
            links -= sum(t == "a" for t, _ in closed)
            main -= sum(t in MAIN for t, _ in closed)
            for t, started in reversed(closed[1:]):
                if t in MAIN and not started:
                    yield "</" + t, "", inside > 0
            yield "</" + tag + (" p" if tag == "a" and prose else ""), "", inside > 0
            continue
        if tag in VOID or m[4].endswith("/") and tag not in BLOCKS:
            yield "<" + tag, "", depth > 0
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            if stack.pop()[1]:
                depth -= 1
        if tag == "a" and links:  # links do not nest: the open one has lost its end tag
            at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "a")
            if not stack[at][1]:
                del stack[at]
                links -= 1
        if tag == "a":
            prose = any(t == "p" for t, _ in stack[-4:])
        skip = _furniture(tag, m[4], main > 0, m.start() in exempt)
        stack.append((tag, skip))
        links += tag == "a"
        main += tag in MAIN
        yield ("<!" if skip else "<" + tag + (" p" if tag == "a" and prose else "")), tag if skip else "", depth > 0
        depth += skip
    for t, started in reversed(stack):
        if t in MAIN and not started:
            yield "</" + t, "", depth > 0


# --- labelled pages -------------------------------------------------------------------------------------------------

#: Bracket the main text of a labelled page.
BEGIN, FINISH = "<!--main-->", "<!--/main-->"


def labelled_pages(count: int = 240, seed: int = 7) -> list[str]:
    """Made pages of several layouts whose main text is bracketed by comments; the same pages on every call."""
    r = random.Random(seed)
    say = lambda a, b: " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))
    pages = []
    for k in range(count):
        links = "".join(f'<li><a href="/{k}">{say(1, 3)}</a></li>' for _ in range(r.randint(3, 12)))
        menu = r.choice([f"<nav><ul>{links}</ul></nav>", f'<div class="menu"><ul>{links}</ul></div>', f"<ul>{links}</ul>", f"<div><table><tr><td><ul>{links}</ul></td></tr></table></div>"])
        top = r.choice(["", f"<header><h1>{say(1, 4)}</h1></header>", f'<div id="top"><span>{say(1, 5)}</span></div>'])
        advert = r.choice(["", f'<div class="ad">{say(5, 15)}</div>', f"<div><span>{say(2, 6)}</span></div>"])
        body = f"<h1>{say(3, 10)}</h1>" if r.random() < 0.8 else ""
        for _ in range(r.randint(1, 14)):
            text = say(1, 90)
            if r.random() < 0.3:
                text = f"<b>{say(1, 6)}</b> {text} <a href='/x'>{say(1, 3)}</a> {say(1, 9)}"
            body += r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<h2>{say(2, 6)}</h2><p>{text}</p>", f"<ul><li>{say(3, 14)}</li><li>{say(3, 14)}</li></ul>", f"{text}<br>{say(3, 30)}<br>"])
            if r.random() < 0.4:
                cell, link = lambda a, b: r.choice([say(a, b)] * 3 + [f"<span>{say(a, b)}</span>"]), lambda: f"<a href='/y'>{say(1, 3)}</a>"
                wide, opened = r.randint(2, 7), r.choice(["<tbody>", ""])
                rows = "".join("<tr>" + "".join(f"<td>{cell(1, 2)}</td>" for _ in range(wide)) + "</tr>" for _ in range(r.randint(3, 30)))
                body += r.choice([
                    f"<table><thead><tr>{''.join(f'<th>{say(1, 2)}</th>' for _ in range(wide))}</tr></thead>{opened}{rows}{opened.replace('<', '</')}</table>",
                    "".join(f"<div>{say(4, 20)}</div>" for _ in range(r.randint(2, 12))), "<div>" + "".join(f"<div><p>{say(5, 30)}</p></div>" for _ in range(r.randint(1, 5))) + "</div>",
                    f"<section><h3>{say(1, 5)}</h3><p>{say(8, 50)}</p></section>", "<p>" + " ".join(f"<span>{say(1, 3)}</span>" for _ in range(r.randint(4, 30))) + "</p>",
                    f"<p>{say(3, 9)} <code>{say(1, 2)}</code> {say(2, 9)}</p><pre><code>{say(5, 40)}</code></pre>", f"<figure><img src='/i'><figcaption>{say(3, 14)}</figcaption></figure>",
                    "<p>" + " ".join(f"{say(1, 5)} {link()}" for _ in range(r.randint(4, 25))) + "</p>", "<p>" + ", ".join(link() for _ in range(r.randint(4, 12))) + f" {say(3, 12)}</p>",
                ])
            if r.random() < 0.05:
                body += f'<div class="promo">{say(4, 12)}</div>'
        open_, close = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<section>", "</section>")])
        related = r.choice(["", f"<aside>{say(8, 30)}</aside>", f"<div><h3>{say(1, 2)}</h3><ul>{links}</ul></div>"])
        notes = r.choice(["", "", f'<section class="comments"><p>{say(5, 40)}</p></section>'])
        foot = r.choice([f"<div><p>{' | '.join(f'<a>{say(1, 2)}</a>' for _ in range(r.randint(2, 9)))}</p></div>", f"<footer>{say(3, 12)}</footer>", f"<div>&copy; {say(2, 8)}</div>", f"<div><p>{say(3, 9)}</p><a href='/t'>{say(1, 2)}</a></div>"])
        pages.append(f"<html><body>{top}{menu}{advert}{open_}{BEGIN}{body}{FINISH}{close}{notes}{related}{foot}</body></html>")
    return pages


#: Bounds of a learned weight's size; a tag or word of a link weighs no more than TAG_MOST, so that a run of them in the
#: middle of a text does not outweigh the words on its lighter side.
LEAST, MOST, TAG_MOST = 0.05, 3.0, 1.5
#: Occurrences inside and outside that every class has at first.
PRIOR = 20


@cache
def learned_weights() -> dict[str, float]:
    """Log-odds of every class by the labelled pages: positive for words, negative for links and tags. "<" stands for
    tags that no labelled page has."""
    inside, outside = Counter(), Counter()
    for page in labelled_pages():
        before, rest = page.split(BEGIN)
        body, after = rest.split(FINISH)
        for part, counts in ((before, outside), (body, inside), (after, outside)):
            for kind, text, skipped in items(part):
                if not skipped:
                    counts[kind] += len(text.split()) if kind in TEXTS else 1
    a, b = sum(inside.values()), sum(outside.values())
    out = {}
    for kind in inside | outside:
        odds = math.log((inside[kind] + PRIOR) / (a + PRIOR)) - math.log((outside[kind] + PRIOR) / (b + PRIOR))
        out[kind] = min(max(odds, LEAST), MOST) if kind == "word" else max(min(odds, -LEAST), -TAG_MOST)
    out["<"] = -LEAST * 4
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, stop) of the contiguous run with the largest sum, the first and longest of equal ones; (0, 0) if no
    score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and total > 0:
            best, found = total, (start, i + 1)
    return found


def _edge(kind: str, text: str) -> bool:
    """Whether a block starts or ends at the piece."""
    return (text if kind == "<!" else kind.lstrip("</")) in BLOCKS and kind not in TEXTS


#: Share of a region's words that an article or main must hold for the region to take its edges.
HELD = 0.8


def snapped(pieces: list[tuple[str, str, bool]], start: int, stop: int) -> tuple[int, int, bool]:
    """The region [start, stop) at edges of the structure: the smallest article or main that holds HELD of its words
    (True), or else whole blocks (False)."""
    sizes = [len(text.split()) if kind in TEXTS and not skipped else 0 for kind, text, skipped in pieces]
    upto = [0, *accumulate(sizes)]
    inside = upto[stop] - upto[start]
    opened: list[int] = []
    spans = []
    for k, (kind, _, skipped) in enumerate(pieces):
        if kind in ("<article", "<main") and not skipped:
            opened.append(k)
        elif kind in ("</article", "</main") and not skipped and opened:
            spans.append((opened.pop(), k + 1))
    best = None
    for a, b in spans:
        shared = upto[max(min(b, stop), start)] - upto[min(max(a, start), stop)]
        if shared >= HELD * inside and (best is None or b - a < best[1] - best[0]):
            best = (a, b)
    if best:
        return *best, True
    while start > 0 and not _edge(*pieces[start - 1][:2]):
        start -= 1
    while stop < len(pieces) and not _edge(*pieces[stop][:2]):
        stop += 1
    return start, stop, False


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the page's main text joined by blank lines; empty if there is none."""
    if not page:
        return ""
    other = weights["<"]
    pieces = list(items(page))
    scores = []
    for kind, text, skipped in pieces:
        if skipped:
            scores.append(0.0)
        elif kind in TEXTS:
            scores.append(weights[kind] * len(text.split()))
        else:
            scores.append(weights.get(kind, other))
    start, stop = best_region(scores)
    if start == stop:
        return ""
    start, stop, told = snapped(pieces, start, stop)
    blocks, current = [], []

    def close() -> None:
        if current and (block := _SPACE.sub(" ", html.unescape("".join(current))).strip()):
            blocks.append(block)
        current.clear()

    for kind, text, skipped in pieces[start:stop]:
        if kind in TEXTS:
            if not skipped:
                current.append(text)
        elif kind == "<br" and not skipped:
            current.append(" ")
        elif _edge(kind, text) and (not skipped or kind == "<!"):
            close()
    close()
    while not told and len(blocks) > 1 and NOTICE.fullmatch(blocks[0]):
        del blocks[0]
    while not told and len(blocks) > 1 and NOTICE.fullmatch(blocks[-1]):
        del blocks[-1]
    return "\n\n".join(blocks)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: (id, url, text, n_chars), n_chars the code points of text.

    Null html and pages without any main text give an empty text and 0. Broken markup never fails: an end tag without
    its start is ignored, open elements end with their parent. Rows that repeat give equal rows; an empty table gives
    an empty result; extra columns are ignored.
    """

    weights = learned_weights()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(page, weights) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    slim = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(slim.dtypes)
    out = slim.mapInArrow(scan, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
