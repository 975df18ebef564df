"""The scanner of pages: linear on broken pages, values with apostrophes, marks inside articles."""

import time

import pytest

from styloweave.llm.op01_html import main_text, page_blocks, tags


def text(page, neighbour=None):
    return main_text(page_blocks(page), neighbour)


@pytest.mark.parametrize("piece", ['<a ', '<a "', "<a '", '<a x="', '<svg ', '<!', '<!--', '<script', '</', '<div>', '<p x=', '<', '<a x="">',
                                   '<svg>', '<title', '<div></p>', "<a b='c\">"])
def test_broken_pages_take_linear_time(piece):
    page = "<p>start</p>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    assert text(page).startswith("start")
    list(tags(page + ">"))
    assert time.process_time() - began < 8      # a second or so; a quadratic scan takes hours


def test_values_and_quotes():
    assert text("<p data-x=it's>z</p>") == "z"
    assert text("<p title='a > b' alt=\"c > d\">z</p><p x=\"open>y</p>") == "z y"
    assert text("<p \"odd\">z</p>a < b <3") == "z a < b <3"
    assert text("<svg class=\"icon\"/><p>kept</p><svg><text>no</text></svg><p>too</p>") == "kept too"
    assert text("<my-box><p>in</p></my-box><title-bar>x</title-bar>") == "in x"
    assert text("a<!-- <p>b</p> --><SCRIPT>c</script >d<style>e") == "ad"


def test_marks_inside_articles():
    assert text('<article><p>A</p><div class="notice">N</div><div class="alert">al</div></article>') == "A"
    assert text('<article><p>A</p><div id="comments-area">C</div><ul class="menu"><li>m</li></ul></article>') == "A"
    assert text('<article><section id="comments-on-the-law"><p>B</p></section><h2 id="search">H</h2></article>') == "B H"
    assert text('<article><section id="discussion">D</section></article>') == "D"
    assert text('<article>A<div class="replies">r</div><div class="promo">p</div>B</article>') == "A B"
