"""Elements without end tags do not take the rest of a page."""

import numpy as np
import pytest

from corpusledger.llm import html

BODY = "<article><h1>Title here</h1><p>One and more words.</p><p>Two and more words.</p></article>"
WANT = "Title here One and more words. Two and more words."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<form><datalist><option value=a>A<option value=b>B</datalist></form>" + BODY, WANT),
        ("<p>One</p><svg class=i /><p>Two</p>", "One Two"),
        ("<svg><path d='M0'/><g><text>no</text></g></svg>" + BODY, WANT),
        ("<form><label>Name</form>" + BODY, WANT),
        ("<button>Go" + BODY, WANT),
        ("<form><select><option>a<option selected>b</select></form>" + BODY, WANT),
        ("<p>Let <math><mi>x</mi></math> be <object>shown</object> here</p>", "Let x be shown here"),
        ("<p>a<button>no</button>b</p><template><p>no</p></template><p>c</p>", "ab c"),
        ("<article><p>One</p><button><div>Subscribe now</div><p>free</p></button><p>Two</p></article>", "One Two"),
        ("<article><p>One</p><select><option><div>a</div></select><p>Two</p></article>", "One Two"),
        ("<p>One</p><svg><foreignObject><div>no</div></foreignObject></svg><p>Two</p>", "One Two"),
        ("<p>Set the <label>big knob</label> to three</p>", "Set the big knob to three"),
        ("<p>One</p><label for=x><div>Mail</div></label><p>Two</p>", "One Two"),
        ("<p>One</p><label>Tick <input type=checkbox></label><p>Two</p>", "One Two"),
        ("<button>Go<button>Stay</button><p>One</p>", "One"),
    ],
)
def test_open_elements_do_not_take_the_page(page, want):
    tree = html.Tree(page)
    assert tree.text(np.ones(len(tree.tags), bool)) == want


@pytest.mark.parametrize("page", ["<p>Only one paragraph of plain words here.</p>", "Plain words without any tag.", "<p>One of three.<p>Two of three.<p>Three of three."])
def test_pages_without_structure_are_their_text(page):
    model = html.fit()
    tree = html.Tree(page)
    assert tree.text(model.keep(tree)) == tree.text(np.ones(len(tree.tags), bool)) != ""


def test_many_labels_and_controls_are_read_in_linear_time():
    tree = html.Tree("<label>" * 30_000 + "<div><label><input>" * 30_000)
    assert len(tree.tags) > 1
