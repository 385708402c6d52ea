"""Main text of short, unmarked and oddly named pages, against what they were made of."""

from __future__ import annotations

import random

import pytest

from tallyframe.llm import html_text

TREE = html_text.trained()


def text(html: str) -> str:
    return html_text.main_text(html, TREE)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Ok</p>", "Ok"), ("<p>Three short words.</p>", "Three short words."), ("<pre>x = 1</pre>", "x = 1"), ("no markup at all", "no markup at all"), ("<div>One</div><div>Two words</div>", "One\nTwo words"),
        ("<nav><a href='/'>Home</a></nav><p>Short.</p><footer>2024 Somebody</footer>", "Short."), ("<h1>Title</h1><p>a b</p>", "Title\na b"),
        ("<div class='ad'>Buy this now.</div>", ""), ("<div class='cookie-notice'>We use cookies.</div>", ""), ("<ul><li><a href='/'>a</a></li><li><a href='/'>b c</a></li></ul>", ""),
    ],
)
def test_short_pages(html, want):
    assert text(html) == want and text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{html}</body></html>") == want


def test_names_of_both_kinds():
    body = "<h1>On copyright</h1><p>First words of the law.</p><p>" + "many words " * 40 + "</p>"
    whole = "On copyright\nFirst words of the law.\n" + ("many words " * 40).strip()
    for name in ("legal-text", "copyright-law-article", "search-story body", "content"):
        assert text(f"<nav><ul><li><a href='/'>x</a></li></ul></nav><div class='{name}'>{body}</div><footer>c</footer>") == whole, name
    # where it isn't most of the page, such a name says what it says of others
    assert text(f"<article>{body}</article><div class='footer-text'><p>Address and so on.</p></div>") == whole
    assert text(f"<div>{body}</div><div class='cookie-text'><p>We use cookies here.</p></div>") == whole
    assert text(f"<div class='sidebar'>{body}</div><p>Here.</p>") == "Here."


def test_link_lists_of_an_article_go():
    links = "".join(f"<li><a href='/{k}'>tag {k}</a></li>" for k in range(5))
    page = f"<article><h1>T</h1><ul>{links}</ul><p>Some words here.</p><ul><li>plain item</li><li>see <a href='/'>there</a> for more of it</li></ul><p>End.</p><ul>{links}</ul></article>"
    assert text(page) == "T\nSome words here.\nplain item\nsee there for more of it\nEnd."
    assert text("<article><p>Some words here.</p><p><a href='/x'>one link alone</a></p><p>End.</p></article>") == "Some words here.\none link alone\nEnd."


def test_inline_elements_that_are_not_shown():
    assert text("<p>a <span style='display: none'>b <b>c</b> <span>d</span> e</span>f</p>") == "a f"
    assert text("<p>a <i hidden>b</i>c <span aria-hidden='true'>*</span>d <span style='color:red'>e</span></p>") == "a c d e"
    assert text("<p>a <span hidden>never closed</p><p>b c d e</p>") == "a\nb c d e"


def test_made_pages():
    """Text of any length, marked or not, among what stands around; no page of these was trained on."""
    r, wrong = random.Random(77), 0
    vocabulary = "river stone cloud under seven quiet lamp paper wolf garden copper tide".split()
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize()
    size = lambda: r.choice([1, 2, 3, 6, 11, 25, 48, 90, 140])
    for _ in range(500):
        around = [
            lambda: f"<nav><ul>{''.join(f'<li><a href=/{k}>{say(1)}</a></li>' for k in range(r.randint(2, 6)))}</ul></nav>", lambda: f"<div class='ad'>{say(size())}.</div>",
            lambda: f"<aside><p>{say(size())}.</p></aside>", lambda: f"<div id='cookie-banner'><p>{say(size())}.</p></div>", lambda: f"<footer>&copy; {say(size())}.</footer>",
            lambda: f"<section class='comments'><h3>{say(1)}</h3><p>{say(size())}.</p></section>", lambda: f"<form action='/s'><input name=q><button>{say(1)}</button></form>", lambda: f"<script>var t='<p>{say(3)}</p>';</script>",
        ]
        own = [say(size()) + "." for _ in range(r.randint(1, 5))]
        body = "".join(f"<p>{t}</p>" for t in own)
        if r.random() < 0.5:
            own.insert(0, say(r.randint(2, 6)))
            body = f"<h1>{own[0]}</h1>{body}"
        body = r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "{}", "<div class='entry-content'>{}</div>"]).format(body)
        some = lambda: "".join(r.choice(around)() for _ in range(r.randint(0, 3)))  # noqa: B023, E731
        wrong += text(f"<html><body>{some()}{body}{some()}</body></html>") != "\n".join(own)
    assert wrong <= 5  # 1 in 100
