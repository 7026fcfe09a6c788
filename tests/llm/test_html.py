"""Pages without an article element, names that mislead, links and buttons within the text, hostile markup."""

import random
import time

import pytest

from gleaner.llm.html_extract import main_text

P = [f"Paragraph {i} has quite some words in it, so that it counts as running text." for i in range(1, 9)]
TAGS = "".join(f"<p>{p}</p>" for p in P[:2])
TEXT = "\n\n".join(P[:2])
LINKS = "".join(f"<li><a href=x>{w} reference</a></li>" for w in ("First", "Second", "Third", "Fourth"))
REFERENCES = "\n\n".join(f"{w} reference" for w in ("First", "Second", "Third", "Fourth"))


def test_links_between_text_stay():
    assert main_text(f"<p>{P[0]}</p><ul>{LINKS}</ul><p>{P[1]}</p>") == f"{P[0]}\n\n{REFERENCES}\n\n{P[1]}"
    assert main_text(f"<article><p>{P[0]}</p><ul>{LINKS}</ul></article>") == f"{P[0]}\n\n{REFERENCES}"


def test_links_before_and_after_text_go():
    menu = f"<ul>{LINKS}</ul>"
    assert main_text(f"{menu}<div>{TAGS}</div>{menu}<div><p>Copyright words</p></div>") == TEXT
    assert main_text(f"{menu}<div><h1><a href=x>Linked title</a></h1>{TAGS}</div>") == f"Linked title\n\n{TEXT}"


@pytest.mark.parametrize("name", ["widget-area page-wrapper", "search-results", "has-sidebar sidebar", "comments-page", "menu"])
def test_a_name_does_not_empty_a_page(name):
    assert main_text(f'<div class="{name}">{TAGS}<div class="sidebar"><p>side text here</p></div></div><footer>foot</footer>') == TEXT
    assert main_text(f'<div class="{name}"><div class="{name}">{TAGS}</div></div>') == TEXT


def test_a_long_advert_beside_a_short_article_goes():
    advert = f'<div class="ad">{TAGS}</div>'
    assert main_text(f"{advert}<article><h1>Short.</h1></article>") == "Short."
    assert main_text(f"{advert}<div><p>{P[2]}</p><p>{P[3]}</p><p>{P[4]}</p></div>") == "\n\n".join(P[2:5])
    assert main_text(f'<div style="display:none">{TAGS}</div><p>{P[2]}</p>') == P[2]


def test_text_beside_a_small_main_element_stays():
    assert main_text(f"<main><h1>Short title</h1></main>{TAGS}") == f"Short title\n\n{TEXT}"
    assert main_text(f"<main>{TAGS}</main><p>foot</p>") == TEXT


def test_buttons_and_labels_in_a_sentence():
    for outer in ("article", "div"):
        assert main_text(f"<{outer}><p>Press <button>Save</button> and choose <label>Name</label> now, then read on.</p></{outer}>") == "Press Save and choose Name now, then read on."
    assert main_text(f"<form><p>Your <label>name</label> <button>Send</button></p></form>{TAGS}") == TEXT
    assert main_text(f"<div>{TAGS}<button>Share</button></div>") == TEXT
    assert main_text("<article><p>Choose <select><option>one</option></select> of them.</p></article>") == "Choose of them."


def test_generated_pages_without_an_article_element():
    draw = random.Random(4)
    for _ in range(300):
        blocks = [draw.choice(["{}", "{} <b>bold</b> end", "{}<br>{}"]).format(draw.choice(P), draw.choice(P)) for _ in range(draw.randrange(1, 7))]
        want = "\n\n".join(b.replace("<b>", "").replace("</b>", "").replace("<br>", " ") for b in blocks)
        body = "".join(f"<p>{b}</p>" for b in blocks)
        wrapper = draw.choice(['<div id="content">{}</div>', '<div class="page-wrapper widget-area">{}</div>', "<section>{}</section>", "<table><tr><td>{}</td></tr></table>"])
        before = draw.choice(["", f"<nav><ul>{LINKS}</ul></nav>", f"<ul>{LINKS}</ul>", '<div class="cookie-notice">We use cookies.</div>', "<header><h1>Site</h1></header>"])
        after = draw.choice(["", "<footer>Copyright</footer>", f"<ul>{LINKS}</ul>", '<div class="comments"><p>Nice!</p></div>', "<aside><p>Aside text.</p></aside>"])
        assert main_text(f"<html><head><title>t</title></head><body>{before}{wrapper.format(body)}{after}</body></html>") == want


@pytest.mark.parametrize(
    "page",
    [
        "<body><div>" * 90_000, "<head>" * 60_000 + "<body>" * 60_000, "<div class=ad>x" * 60_000, "<p><b>x" * 90_000, "<p><button>" * 90_000,
        "<article><div>t</div>" * 50_000, f"<p>t</p>{'<li><a href=x>y</a></li>' * 40_000}<p>t</p>", "<div class=menu><p>t</p>" * 40_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    took = []
    for share in (0.25, 1):
        began = time.process_time()
        main_text(page[: int(len(page) * share)])
        took.append(time.process_time() - began)
    assert took[1] < max(8 * took[0], 4.0)
