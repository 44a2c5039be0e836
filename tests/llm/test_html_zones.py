"""What names and tags do to the main text, within the article and outside of it."""

import pytest

from strandloom.llm.html_text import main_text

SENTENCE = "The river rose in the night, and by noon, as the old men had said, it stood at the door."
MORE = "Nobody slept; some prayed, others carried what they could to the roof, and waited."


def page(inside="", outside=""):
    return f"<html><body><nav><a href='/'>Home</a></nav>{outside}<article><h1>The flood</h1><p>{SENTENCE}</p>{inside}<p>{MORE}</p></article><footer>All rights reserved.</footer></body></html>"


OWN = [
    '<section class="related-work"><p>Others wrote of it.</p></section>',
    '<section class="search"><p>They searched for days.</p></section>',
    '<p class="alert">The water was high.</p>',
    '<p class="legal">The law was silent.</p>',
    '<div data-id="menu">Bread and fish.</div>',
    '<div data-class="ad" alt="advert">Bread again.</div>',
    '<p>He was <span title="a hidden gem">a gem</span> of a man.</p>',
    '<p><img alt="hidden" src="x">A picture of it.</p>',
    '<p class="share-price">It fell by half.</p>',
    '<div class="menu-of-the-day">Soup.</div>',
    '<p>Press <button>Go</button> to go, or read the <label>label</label> first.</p>',
    '<p style="color:red">A red line.</p>',
    '<p data-x="display:none">Seen.</p>',
]
OTHERS = [
    '<div class="ad">Buy boats now, cheap and fast, only today.</div>',
    '<div class="ad-banner top">Buy boats now, cheap and fast, only today.</div>',
    '<aside>See the other story of the flood, with pictures, maps and more.</aside>',
    '<section class="comments"><p>Great article, I like it. Really, I do, and so does my wife.</p></section>',
    '<div id="comment-list"><p>Great article, I like it. Really, I do, and so does my wife.</p></div>',
    '<div class="share-buttons">Share it, like it, post it.</div>',
    '<div class="cookie-notice">We use cookies, as you know, and so do others.</div>',
    '<p hidden>Nobody sees this line, whatever it says.</p>',
    '<p style="margin:0; display:none">Nobody sees this line, whatever it says.</p>',
    '<span aria-hidden="true">Nobody sees this line.</span>',
    '<form><p>Your name, please: <input></p></form>',
    '<div class="newsletter">Subscribe now, and read us every week.</div>',
    '<script>var x = "not a text, never.";</script>',
]


def plain(html):
    import re

    return [" ".join(t.split()) for t in re.sub(r"<[^>]*>", "", html).split("\n") if t.strip()]


@pytest.mark.parametrize("inside", OWN)
def test_article_keeps_its_own(inside):
    assert main_text(page(inside)) == "\n".join(["The flood", SENTENCE, *plain(inside), MORE])


@pytest.mark.parametrize("inside", OTHERS)
def test_article_loses_what_is_not_its_own(inside):
    assert main_text(page(inside)) == "\n".join(["The flood", SENTENCE, MORE])
    assert main_text(page("", inside)) == "\n".join(["The flood", SENTENCE, MORE])


@pytest.mark.parametrize("name", ["related", "search", "legal", "alert", "menu", "banner"])
def test_names_weigh_outside_of_the_article(name):
    assert main_text(page("", f'<div class="{name}"><p>Something short.</p></div>')) == "\n".join(["The flood", SENTENCE, MORE])


def test_zones_against_the_list_of_their_texts():
    """Every choice of own and other elements in turn, by the list of what has to stay."""
    for i in range(0, len(OWN) * len(OTHERS), 3):
        own, other = OWN[i % len(OWN)], OTHERS[i % len(OTHERS)]
        assert main_text(page(other + own + other)) == "\n".join(["The flood", SENTENCE, *plain(own), MORE]), (own, other)
