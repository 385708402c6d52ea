"""Main text of web pages: flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block is described
by its word count and link density, by those of its two neighbours, and by what the innermost
container that says what it is for says. A decision tree, trained at call time on the blocks
of a few small labelled pages, tells main text from the rest.
"""

from __future__ import annotations

import re
from html import unescape
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text of the page, or belongs to a form.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select button textarea option title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
#: Elements, and words of a class or id, that say what a container is for.
AROUND_TAGS = frozenset("nav footer aside menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
AROUND_WORDS = frozenset(
    "ad ads advert advertisement adsense banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget "
    "cookie cookies consent gdpr notice alert popup modal overlay share sharing social related "
    "recommended newsletter subscribe subscription signup login search copyright legal disclaimer toolbar pagination pager skip contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies discussion respond".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
MAIN_WORDS = frozenset("article content main post entry story body text".split())
#: A name that begins so says what a container has or lacks, not what it is.
ABOUT_OTHERS = frozenset("has with without no is hide show".split())

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z) | <[!?][^>]*+(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']|"[^"]*"|'[^']*')*+)> | <(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL | re.VERBOSE,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_SKIPPED_TAG = re.compile(rf"<(/?)({'|'.join(sorted(SKIPPED - RAW))})(?=[\s/>])[^>]*>?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "in_around", "in_main", "page_has_main", "heading", "sentence_end", "item",
)


def _hides(key: str, value: str) -> bool:
    return key == "hidden" or key == "style" and bool(_HIDDEN.search(value)) or key == "aria-hidden" and value.lower() == "true"


def _is_hidden(attributes: str) -> bool:
    return ("hidden" in attributes or "style" in attributes) and any(_hides(key.lower(), "".join(values)) for key, *values in _ATTRIBUTE.findall(attributes))


def _purpose(tag: str, attributes: str) -> str | None:
    """What an element says it is for: hidden, comment, around, weak (around by its names alone), mixed (by
    a name that says main as well), form, head, main, part (main by its names alone), or nothing. An
    article or main element is what its tag says unless it is hidden or of comments."""
    names: list[set[str]] = []
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if _hides(key, value):
                return "hidden"
            if key in ("class", "id", "role"):
                names += [{w.lower() for w in words} for name in value.split() if (words := _WORDS.findall(name)) and words[0].lower() not in ABOUT_OTHERS]
    if tag in MAIN_TAGS:
        return "comment" if any(x & COMMENT_WORDS and not x & MAIN_WORDS - {"body", "text"} for x in names) else "main"
    if any(x & COMMENT_WORDS for x in names):
        return "comment"
    if tag in AROUND_TAGS:
        return "around"
    if tag == "form":
        return "form"
    weak, part = any(x & AROUND_WORDS for x in names), any(x & MAIN_WORDS and not x & (AROUND_WORDS | HEAD_WORDS) for x in names) and tag in ("div", "section", "td")
    if weak and not part:
        return "mixed" if all(x & MAIN_WORDS for x in names if x & AROUND_WORDS) else "weak"
    if tag == "header" or any(x & HEAD_WORDS for x in names):
        return "head"
    return "part" if part and not weak else None


def _place(chain: list[tuple[str, int]], large: set[int]) -> str | None:
    """What a block's containers, from the outermost on, come to: main, around or nothing. Hidden
    elements, comments and containers that are around by their tag hold all that is in them; an
    article or main element outweighs containers that are around by name; a form, or a container of mixed
    names, that holds most of the page says nothing; the head of main text belongs to it."""
    place = None
    for purpose, number in chain:
        if purpose in ("hidden", "comment", "around") or purpose == "form" and number not in large:
            return "around"
        if purpose == "main":
            place = "main"
        elif purpose == "weak" or purpose == "mixed" and number not in large:
            place = "weak"
        elif purpose == "head":
            place = place or "weak"
        elif purpose == "part" and place != "weak":
            place = "main"
    return "around" if place == "weak" else place


def _ends(html: str) -> dict[int, int]:
    """For each skipped element that is closed where its content begins and where what follows it does."""
    opened: dict[str, list[int]] = {}
    out = {}
    for m in _SKIPPED_TAG.finditer(html):
        tag = m[2].lower()
        if not m[1]:
            opened.setdefault(tag, []).append(m.end())
        elif opened.get(tag):
            out[opened[tag].pop()] = m.end()
    return out


class Block:
    __slots__ = ("text", "words", "linked", "chain", "place", "heading", "item")

    def __init__(self, text: str, linked: int, chain: list[tuple[str, int]], heading: bool, item: bool) -> None:
        self.text, self.linked, self.chain, self.heading, self.item, self.place = text, linked, chain, heading, item, None
        self.words = text.count(" ") + 1


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order: character references decoded, white space turned
    into single spaces, trimmed, none empty."""
    out: list[Block] = []
    # open elements: tag, and the purposes of those around it and itself, with their numbers
    stack: list[tuple[str, list[tuple[str, int]]]] = []
    texts: list[tuple[str, bool]] = []
    in_link, muted, number, ends = False, False, 0, _ends(html)
    unseen, depth = "", 0  # an inline element that isn't shown, and how many of its kind are open in it

    def close() -> None:
        if texts:
            text = " ".join(unescape("".join(t for t, _ in texts)).split())
            if text:
                linked = sum(len(unescape(t).split()) for t, a in texts if a)
                out.append(Block(text, linked, stack[-1][1] if stack else [], any(t in HEADINGS for t, _ in stack[-2:]), any(t in ITEMS for t, _ in stack[-2:])))
            texts.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        start = m.start() if m else end
        if start > at and not muted and not depth:
            texts.append((html[at:start], in_link))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if closing or attributes.endswith("/") and tag not in RAW:
                continue
            if tag in RAW:  # its content is not markup
                found = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                if found:
                    at = html.find(">", found.start())
                    at = at + 1 if at >= 0 else end
                elif tag not in ("title", "textarea", "noscript"):
                    at = end
            elif at in ends:
                at = ends[at]
            elif tag != "option":
                muted = True  # never closed: up to the next block
            continue
        if tag not in BLOCK and tag not in VOID:
            if depth:
                depth += (tag == unseen) * (-1 if closing else 1)
            elif not closing and attributes and not attributes.endswith("/") and _is_hidden(attributes):
                unseen, depth = tag, 1
        if tag == "a":
            in_link = not closing
        elif tag == "br" or tag == "wbr":
            texts.append((" " if tag == "br" else "", in_link))
        elif tag in BLOCK:
            close()
            muted, depth = False, 0
            # a paragraph or heading ends where any block begins or ends
            while stack and stack[-1][0] == "p" or not closing and stack and stack[-1][0] in HEADINGS:
                stack.pop()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in ("li", "dt", "dd", "td", "th", "tr"):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                        if stack[k][0] in ("ul", "ol", "dl", "table", "menu"):
                            break
                outer = stack[-1][1] if stack else []
                own = "hidden" if tag == "head" else _purpose(tag, attributes) if tag not in ("html", "body") else None
                number += 1
                stack.append((tag, [*outer, (own, number)] if own else outer))
    close()
    words: dict[int, int] = {}
    for b in out:
        for purpose, k in b.chain:
            if purpose in ("form", "mixed"):
                words[k] = words.get(k, 0) + b.words
    large = {k for k, n in words.items() if 2 * n > sum(b.words for b in out)}
    for b in out:
        b.place = _place(b.chain, large)
    return out


def features(found: list[Block]) -> list[tuple]:
    """One row of FEATURES for each block."""
    size = [(b.words, b.linked / b.words) for b in found]
    has_main = float(any(b.place == "main" for b in found))
    rows = []
    for k, b in enumerate(found):
        before, after = size[k - 1] if k else (0, 0.0), size[k + 1] if k + 1 < len(found) else (0, 0.0)
        around = float(b.place == "around")
        rows.append((*size[k], *before, *after, around, float(b.place == "main"), has_main, float(b.heading), float(b.text[-1] in ".!?…:。\"”»"), float(b.item)))
    return rows


# A decision tree: (feature, limit, tree at or under the limit, tree over it), or a share of main text.


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12, least: int = 1):
    """Binary splits of lowest Gini impurity; between equal ones the first feature and the lowest limit."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= limit
            n, m = int(left.sum()), int((~left).sum())
            if min(n, m) < least:
                continue
            p, q = labels[left].mean(), labels[~left].mean()
            cost = n * p * (1 - p) + m * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(limit), left)
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return share
    _, f, limit, left = best
    return f, limit, grow(rows[left], labels[left], depth - 1, least), grow(rows[~left], labels[~left], depth - 1, least)


def decide(tree, row: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _say(n: int, word: str = "lorem") -> str:
    return " ".join([word] * n)


def _mixed_page(r: Random) -> str:
    """A page put together by chance: what stands around, and text of any length, marked or not."""
    link = lambda each: f'<a href="/">{_say(each)}</a>'
    few, many = (lambda: r.choice((1, 2, 3, 5, 8))), (lambda: r.choice((1, 4, 9, 20, 33, 60, 100, 150)))
    end = lambda: r.choice((".", ".", "", "!"))
    links = lambda: f"<ul>{''.join(f'<li>{link(few())}</li>' for _ in range(r.randint(2, 7)))}</ul>"
    name = lambda: r.choice(("ad", "cookie-notice", "sidebar", "footer", "share", "related-posts", "newsletter"))
    around = (
        links, links, lambda: f"<nav>{links()}</nav>", lambda: f"<div class='{name()}'><p>{_say(many())}{end()}</p></div>", lambda: f"<footer><p>{_say(many())}{end()}</p></footer>",
        lambda: f"<aside><p>{_say(many())}{end()}</p></aside>", lambda: f"<div>{link(few())}</div>", lambda: f"<div class='comments'><p>{_say(many())}{end()}</p><p>{_say(few())}</p></div>",
        lambda: f"{links()}<div>{_say(r.randint(1, 3))}</div>{links()}", lambda: "",
    )
    some = lambda: "".join(r.choice(around)() for _ in range(r.randint(0, 3)))
    text = (
        lambda: f"<p>keep {_say(many())}{end()}</p>", lambda: f"<p>keep {_say(many())}{end()}</p>", lambda: f"<div>keep{end()}</div>", lambda: f"<h2>keep {_say(few())}</h2><p>keep {_say(many())}.</p>",
        lambda: f"<ul><li>keep {_say(few())}</li><li>keep {_say(many())}{end()}</li></ul>", lambda: f"<p>keep {_say(many())} {link(few())} {_say(few())}.</p>",
    )
    body = "".join(r.choice(text)() for _ in range(r.randint(1, 5)))
    begin, close = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("", ""), ("", ""), ("<div>", "</div>")))
    if len(begin) > 5:  # what says that it is main leaves out the rest
        body += r.choice(("", links()))
        return some() + r.choice(("", f"<div>{_say(many())}.</div>")) + begin + body + close + r.choice(("", f"<p>{_say(many())}{end()}</p>")) + some()
    return some() + begin + body + close + some()


def labelled_pages() -> list[str]:
    """Small pages written for training; blocks of main text start with "keep"."""
    link = lambda n, each=1: "".join(f'<li><a href="/{k}">{_say(each)}</a></li>' for k in range(n))
    p = lambda n, end=".": f"<p>keep {_say(n - 1)}{end}</p>"
    out = []
    # with an article or main element, short and long blocks in it
    for sizes in ((40, 55, 30), (3, 80, 1), (12, 2, 150)):
        body = "".join(p(n, "." if n != 2 else "") for n in sizes)
        out.append(f'<nav><ul>{link(6)}</ul></nav><div class="ad">{_say(5)}.</div><article><h1>keep {_say(6)}</h1>{body}</article><footer>(c) {_say(25)}.</footer>')
    out.append(f"<header><h1>{_say(3)}</h1><p>{_say(30)}.</p></header><main><h2>keep {_say(4)}</h2>{p(1)}{p(60)}<ul><li>keep {_say(8)}</li></ul></main><aside><p>{_say(45)}.</p></aside>")
    out.append(
        f'<div id="cookie-notice"><p>{_say(28)}.</p></div><article><h1>keep one</h1>{p(25)}<div class="ad-box"><p>{_say(22)}.</p></div>{p(70)}'
        f'<section class="comments"><h3>{_say(2)}</h3><p>{_say(35)}.</p><p>{_say(9)}!</p></section></article><form><p>{_say(14)}.</p></form>'
    )
    out.append(f"<p>{_say(20)}.</p><article>{p(30)}{p(4)}<p>keep <a href='/x'>{_say(5)}</a></p></article><div>{_say(33)}.</div>")
    # without: word counts, link densities and neighbours decide
    out.append(f'<ul>{link(8)}</ul><h1>keep {_say(5)}</h1>{p(40)}{p(14)}{p(90)}<p><a href="/">{_say(3)}</a> | <a href="/">{_say(2)}</a></p><div>{_say(3)}</div>')
    out.append(f'<div><a href="/">{_say(2)}</a></div><div><a href="/">{_say(2)}</a></div><div>keep {_say(60)}.</div><div>keep {_say(45)}.</div><div><a href="/">{_say(6)}</a></div>')
    out.append(f"<table><tr><td><a href='/'>{_say(2)}</a></td><td>{p(50)}{p(22)}{p(35)}</td></tr></table><div>{_say(2)}</div><ul>{link(4, 4)}</ul>")
    out.append(f"<div class='menu'><span>{_say(24)}</span></div>{p(33)}{p(26)}<div class='footer'>{_say(40)}.</div>")
    out.append(f"<h1>keep {_say(3)}</h1>{p(20)}<h2>keep {_say(2)}</h2>{p(25)}")
    out.append(f"{p(12)}")
    # whole pages of a few short blocks, and such beside links
    for n in (1, 2, 3, 5, 9):
        for many in (1, 2, 3):
            out.append(p(n, "") * many)
            out.append(f"<nav><ul>{link(5)}</ul></nav>{p(n, '') * many}<footer><p>{_say(20)}.</p></footer>")
        out.append(f"<h1>keep {_say(n)}</h1>{p(n)}")
        out.append(f"<ul>{link(6)}</ul><div>{_say(n)}</div><ul>{link(6)}</ul>{p(40)}{p(30)}")
    # lists of links in an article: its tags, what it has, what to read next; lists of text stay
    for k in (3, 8):
        for each in (1, 4):
            for begin, end in (("<article>", "</article>"), ("<main>", "</main>")):
                items = f"<ul>{link(k, each)}</ul>"
                out.append(f"{begin}<h1>keep {_say(3)}</h1>{items}{p(30)}<ul><li>keep {_say(3)}</li><li>keep {_say(each)}</li></ul>{p(2, '')}{items}{end}<footer>{_say(9)}.</footer>")
                out.append(f"{begin}{p(12)}<ol><li>keep {_say(20)} <a href='/x'>{_say(each)}</a></li><li>keep {_say(each)}</li></ol>{p(25)}{items}{p(3)}{end}")
    out += [_mixed_page(Random(k)) for k in range(480)]
    # short blocks of the same size: among links they are labels, among text they are text
    label = f"<div><a href='/'>{_say(6)}</a></div><div>{_say(3)}</div><div><a href='/'>{_say(6)}</a></div>"
    for n in (5, 6, 7, 30):
        out.append(f"{label}{p(n)}{p(3, '')}{p(n)}{p(3, '')}{p(n)}{label}")
    for n in (12, 40):
        out.append(f"<div class='notice'>{_say(n)}.</div><ul>{link(5)}</ul>{p(30)}{p(44)}<div class='ad'>{_say(n + 8)}.</div><div><a href='/'>{_say(3)}</a></div>")
        out.append(f"<ul>{link(5)}</ul><aside><p>{_say(n)}.</p></aside><ul>{link(5)}</ul><h1>keep {_say(4)}</h1>{p(36)}<footer>{_say(n)}</footer><ul>{link(3)}</ul>")
    # containers that say what they are for, whatever stands next to them
    befores = [f"<nav><ul>{link(4)}</ul></nav>", f"<div class='ad'>{_say(90)}.</div>", f"<header><p>{_say(12)}</p></header>", f"<div><a href='/'>{_say(3)}</a></div>"]
    afters = [f"<footer>{_say(2)}</footer>", f"<aside><p>{_say(60)}.</p></aside>", f"<ul>{link(5, 3)}</ul>", f"<div class='comments'><p>{_say(30)}.</p><p>{_say(3)}</p></div>"]
    sizes = [(40, 55, 30), (3, 80, 1), (12, 2, 150), (1,), (6, 6, 6), (90,), (2, 3, 4)]
    for k, own in enumerate(sizes):
        for j, (begin, end) in enumerate([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>")]):
            linked = f"<p><a href='/x'>keep {_say(k + 1)}</a></p>" if (k + j) % 2 else ""
            out.append(f"{befores[(k + j) % 4]}{begin}{linked}{''.join(p(n, '.' if n > 2 else '') for n in own)}{linked}{end}{afters[(k + 2 * j) % 4]}")
    return out


def trained(pages: list[str] | None = None):
    found = [(blocks(x)) for x in pages or labelled_pages()]
    rows = np.array([r for b in found for r in features(b)])
    labels = np.array([float(x.text.split()[0].rstrip(".!") == "keep") for b in found for x in b])
    return grow(rows, labels)


def main_text(html: str, tree) -> str:
    found = blocks(html)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row) >= 0.5)


def _extract(tree):
    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """page_id, url, text and n_chars for each row.

    Null html counts as empty; its text is empty, as is that of a page without main text. Pages
    of any length are read whole. Rows that repeat, or share an id, have a row each; ids and
    urls may be null; other columns, whatever their names, are not read; an empty table gives
    no rows.
    """
    slim = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return slim.transform(mapped, _extract(tree if tree is not None else trained()), "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null html is empty, rows that repeat have a row each, pages are read whole,
    an empty table gives no rows, other columns are not read: see ``extract``."""
    return extract(table(spark, sf_dir, "pages"))
