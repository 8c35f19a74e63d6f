import re
from html import unescape

import pytest
from conftest import SF
from pyspark.sql import functions as F

from rillstone.llm import html


@pytest.fixture(scope="module")
def model():
    return html.chain()


def test_given_pages(spark, model):
    """The given pages mark their article; every other word of them is menu, advert, script or footer."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages, model).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?[a-z][^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == " ".join(p for p in parts if p)


def test_held_out_layouts(model):
    wrong = total = 0
    for rows, labels in html.training_pages(80, seed=77):
        wrong += sum(a != b for a, b in zip(model.decode(rows), labels, strict=True))
        total += len(labels)
    assert wrong < 0.02 * total


def test_viterbi_is_the_best_path(model):
    import itertools

    rows = html.training_pages(1, seed=5)[0][0][:8]
    e, s = model.emissions(rows), model.steps
    score = lambda y: sum(e[k][v] for k, v in enumerate(y)) + sum(s[a][b] for a, b in zip(y, y[1:]))
    best = max(itertools.product((0, 1), repeat=len(rows)), key=score)
    assert tuple(model.decode(rows)) == best


def test_blocks_of_broken_markup():
    texts = lambda h: [b.text for b in html.blocks(h)]
    assert texts("<p>a &amp; b&nbsp; c<br>d<p><b>e</i>f") == ["a & b c d", "ef"]
    assert texts("<div>x<!-- <p>no</p> -->y</div><script>if (a</b) {}</script >z<style>q") == ["xy", "z"]
    assert texts("a < b <3 &bogus; &am") == ["a < b <3 &bogus; &am"]
    assert texts("<p title='>'>t</p><p class=\"x>t2</p>") == ["t", "t2"] and texts("<!-- open") == [] and texts(None) == [] and texts("<p") == []
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><TITLE>no</title><textarea><p>t</textarea>") == ["a", "b", "c", "d", "<p>t"]
    assert len(html.blocks("<div>" * 3000 + "x")) == 1 and len(html.blocks("<" * 20_000)) == 1


def test_deep_pages_take_time_in_proportion(model):
    """200,000 elements that are never closed, each with a text; formatting tags; quotes that never end."""
    import time
    import tracemalloc

    for page, n in (("<div>x" * 200_000, 200_000), ("<font>" * 100_000 + "<div>x" * 100_000, 100_000), ("<p><b>y" * 100_000, 100_000), ('<a ">"x' * 50_000, 1), ("<li>x<p>" * 50_000 + "</ul>" * 50_000, 50_000)):
        began = time.time()
        found = html.blocks(page)
        assert len(found) == n and time.time() - began < 20
    tracemalloc.start()
    text = html.main_text("<div>x" * 20_000, model)
    assert set(text) <= {"x", " "} and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


LAYOUTS = [  # written by hand, not by the generator: page, its main text
    ("Only a plain text, with no markup at all.\n\nAnd a second line of it.", "Only a plain text, with no markup at all. And a second line of it."),
    ("<p>Only one.</p>", "Only one."),
    ("<h1>Title here</h1>First paragraph of the story, which is long enough to read.<br><br>Second paragraph of the story, just as long.", "Title here First paragraph of the story, which is long enough to read. Second paragraph of the story, just as long."),
    ("<body><div><p>The story begins with this sentence. It goes on with another one.</p><p>It ends here, at last.</p></div><div>Copyright 2021 Some Company Inc. All rights reserved.</div></body>", "The story begins with this sentence. It goes on with another one. It ends here, at last."),
    ("<nav><a href=/>Home</a> <a href=/a>About</a></nav><article><h2>News</h2><p>Something happened in the town today, people said.</p></article><div>© 2020 Town Paper</div>", "News Something happened in the town today, people said."),
    ("<div class=cookie-banner>We use cookies. <button>OK</button></div><main><p>Ein Satz steht hier, und er ist lang genug.</p><aside>Related: other things</aside><p>Noch ein Satz.</p></main><footer>Impressum</footer>", "Ein Satz steht hier, und er ist lang genug. Noch ein Satz."),
    ("<div id=content><p>One paragraph tells about copyright law and why it was made, at some length, so that nobody takes it for a notice at the foot of a page, which it is not.</p></div>", "One paragraph tells about copyright law and why it was made, at some length, so that nobody takes it for a notice at the foot of a page, which it is not."),
    ("<div class='wrap'><h1>A plain title</h1><p>The first paragraph introduces a list of things.</p><ul><li>point one of the list</li><li>point two</li></ul><p>The last paragraph ends the page.</p></div>", "A plain title The first paragraph introduces a list of things. point one of the list point two The last paragraph ends the page."),
    ("<table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><h1>Old layout</h1><p>This page was made long ago, and it still works well.</p><p>Nobody has changed it since then.</p></td></tr><tr><td>Copyright 2020 X. All rights reserved.</td></tr></table>", "Old layout This page was made long ago, and it still works well. Nobody has changed it since then."),
    ("<div class='row'><div class='col-md-8'><h1>Reading</h1><p>A long text stands in the wide column of the page.</p><p>It has two paragraphs, both of them are kept.</p></div><div class='col-md-4'><h4>Newsletter</h4><form><label>Your mail</label><button>Send</button></form></div></div>", "Reading A long text stands in the wide column of the page. It has two paragraphs, both of them are kept."),
    ("<main><h1>The story</h1><p>It was told by many people over the years.</p></main><div class='text-xs'>Terms Privacy Contact</div>", "The story It was told by many people over the years."),
    ("<div class='page-header'>My site, the best there is</div><div class='content'><h2>Bread</h2><p>Mix flour and water, then wait for an hour.</p><ol><li>Knead it well</li><li>Bake it for forty minutes</li></ol></div><div class='page-footer'>Made with love in Rome</div>", "Bread Mix flour and water, then wait for an hour. Knead it well Bake it for forty minutes"),
    ("<div class='container'><div class='text-center mt-4'><h1>Opening hours</h1><p>We open at nine in the morning, every day but Sunday.</p></div></div><footer><p>© 2022 Shop</p></footer>", "Opening hours We open at nine in the morning, every day but Sunday."),
    ("<nav class='main-nav'><ul><li><a href=/>Start</a></li><li><a href=/b>Blog</a></li></ul></nav><div class='post-body'><p>Heute war ein guter Tag, die Sonne schien lange.</p><blockquote>Ein Zitat steht hier in der Mitte.</blockquote></div><div class='post-comments'><p>Danke für den Text, sehr schön!</p></div>", "Heute war ein guter Tag, die Sonne schien lange. Ein Zitat steht hier in der Mitte."),
    ("<article><h1>Prices</h1><p>The table below shows what things cost this year.</p><table><tr><th>Thing</th><th>Price</th></tr><tr><td>Apples</td><td>3 euros</td></tr></table></article><aside><h3>More</h3><ul><li><a href=/1>One</a></li></ul></aside>", "Prices The table below shows what things cost this year. Thing Price Apples 3 euros"),
    ("<body><div id='top-banner'>Big sale today only!</div><div><h2>Rivers</h2><p>A river carries water from the hills to the sea.</p><h3>Floods</h3><p>When it rains for days, rivers rise and fields are flooded.</p></div><div class='social-share'>Share this page</div></body>", "Rivers A river carries water from the hills to the sea. Floods When it rains for days, rivers rise and fields are flooded."),
    ('<header><h1>Site</h1></header><div class="post"><h1>Post</h1><p>Text of the post, in full sentences.</p></div><div class="comments"><div class="comment"><p>Great post, thanks for it!</p></div></div>', "Post Text of the post, in full sentences."),
]


def test_names_are_judged_whole():
    kinds = lambda x: html._kinds(f' class="{x}"')
    assert [kinds(x) for x in ("text-xs", "col-md-4 text-muted mt-4", "page-footer", "post-comments", "main-nav")] == [(), (), ("footer",), ("comment",), ("nav",)]
    assert [kinds(x) for x in ("text", "article-body", "post page-footer", "entry-content")] == [("main",), ("main",), ("main", "footer"), ("main",)]


@pytest.mark.parametrize("page, text", LAYOUTS)
def test_layouts_from_outside_the_generator(model, page, text):
    assert html.main_text(page, model) == text


def test_edges(spark, model):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>" + "long text here. " * 20_000), (2, "u", "plain only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df, model).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 1] == [""] and "plain only" in {r.text for r in got} and html.extract(df.limit(0), model).count() == 0
