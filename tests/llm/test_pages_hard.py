"""Main text of pages that are hard: no article, odd names, inline forms, deep nesting; and generated pages."""

import random
import time

import pytest

from tidemark.llm.html_text import main_text

LONG = "A paragraph that goes on for a while, as those of articles do when they have something to tell the reader. " * 3
P = f"<p>{LONG}</p>"
TEXT = LONG.strip()


def test_short_lines_around_the_clusters_stay_without_an_article():
    assert main_text(f"<div><h1>Title</h1><p>Short one.</p>{P}<p>End.</p></div>").split("\n\n") == ["Title", "Short one.", TEXT, "End."]
    got = main_text(f"<div>{P * 4}<p>Yes.</p></div>").split("\n\n")
    assert got == [TEXT] * 4 + ["Yes."]
    page = f"<body><div><ul><li>Eggs<li>Milk<li>Flour</ul>{P}<h2>Notes</h2><ul><li>One</li><li>Two</li></ul></div></body>"
    assert main_text(page).split("\n\n") == ["Eggs", "Milk", "Flour", TEXT, "Notes", "One", "Two"]


def test_what_stands_around_a_container_goes():
    page = f"""<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><div>{P}{P}
        <ul><li><a href=c>More of this</a></li><li><a href=d>And of that</a></li></ul><p><a href=e>Only a link</a></p></div><div>(c) 2024</div></body>"""
    assert main_text(page).split("\n\n") == ["Title", TEXT, TEXT, "Only a link"]


@pytest.mark.parametrize("box", ['section class="related-work"', 'section class="discussion"', 'div id="notice"', 'p class="lead search-term"'])
def test_sections_named_after_their_subject_stay(box):
    tag = box.split()[0]
    assert main_text(f"<article>{P}<{box}>{LONG}</{tag}></article>").split("\n\n") == [TEXT, TEXT]
    assert main_text(f"<article>{P}<p class='lead search-term'>A lead.</p></article>").split("\n\n") == [TEXT, "A lead."]


@pytest.mark.parametrize("box", ["comments", "comment-list", "cookie-notice", "ad", "newsletter-box", "share-buttons", "related-posts", "sidebar"])
def test_boxes_of_the_site_inside_an_article_go(box):
    assert main_text(f"<article>{P}{P}{P}<div class='{box}'><p>Something of the site.</p></div></article>").split("\n\n") == [TEXT] * 3


@pytest.mark.parametrize("gone", [
    "<button>Go</button>", "<noscript>no</noscript>", "<label>Name</label>", "<iframe>frame</iframe>", "<svg><text>t</text></svg>",
    "<span hidden>h</span>", "<span style='display: none'>n</span>", "<script>s()</script>", "<b aria-hidden=true>x</b>", "<textarea>t</textarea>",
])
def test_inline_forms_and_hidden_text_go(gone):
    assert main_text(f"<article>{P}<p>before {gone}after</p></article>").split("\n\n") == [TEXT, "before after"]


def test_work_is_proportional_to_the_page():
    began = time.time()
    for page in ("<div>" * 100_000 + "text", "<p><div>" + "<b>" * 30_000 + "<p>x</p>" * 30_000, "<li>" * 50_000 + "</ul>" * 50_000,
                 "<a>" * 50_000 + "x</b>" * 50_000):
        main_text(page)
    assert time.time() - began < 40


def test_generated_pages_give_the_article_their_generator_wrote():
    rng = random.Random(5)
    words = "stone river cloud paper glass winter summer window garden letter music morning".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    def content(depth=0):
        """(html, lines) of a piece of an article, by a plain tree."""
        kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "div", "mixed"] if depth < 3 else ["p"])
        if kind in ("p", "h2"):
            t = say(rng.randint(2, 6) if kind == "h2" else rng.randint(20, 60))
            return f"<{kind}>{t}</{kind}>", [t]
        if kind == "mixed":
            a, b = say(15), say(15)
            return f"<p>{a}<script>x='<p>no</p>'</script> <b>{b}</b><button>No</button></p>", [f"{a} {b}"]
        if kind == "ul":
            items = [say(rng.randint(3, 9)) for _ in range(3)]
            return f"<ul>{''.join(f'<li>{i}' for i in items)}</ul>", items
        inner = [content(depth + 1) for _ in range(rng.randint(1, 3))]
        tag = "blockquote" if kind == "quote" else "div"
        return f"<{tag}>{''.join(h for h, _ in inner)}</{tag}>", [x for _, lines in inner for x in lines]

    for _ in range(200):
        parts = [content() for _ in range(rng.randint(4, 8))]
        first = say(40)
        body, want = f"<p>{first}</p>" + "".join(h for h, _ in parts), [first] + [x for _, lines in parts for x in lines]
        around = [f"<nav><a href=x>{say(2)}</a></nav>", f"<div class=sidebar>{say(4)}</div>", f"<footer>{say(5)}</footer>", f"<form>{say(3)}<input></form>"]
        head, tail = ("".join(rng.sample(around, 2)) for _ in range(2))
        page = f"<html><head><title>{say(3)}</title></head><body>{head}<article>{body}</article>{tail}</body></html>"
        assert main_text(page).split("\n\n") == want
