"""Chat formatting, page extraction and the quality classifier."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import write_tables
from pyspark.sql import functions as F

from palimpsest.llm import quality
from palimpsest.llm.chat_format import Escaper, Template, format_conversations, op2_chat_format, read_back
from palimpsest.llm.html_text import FEATURES, Tags, blocks_of, default_tree, described, grow, labelled_rows, main_text, op4_html_text
from palimpsest.llm.quality import Indicators, fit, held_out, op1_quality, packed, score, unpacked

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escaping_is_reversible():
    template = Template()
    escaper, rng = Escaper(template.all_controls()), random.Random(2)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<", "\\", "s>", "[", "/", "INST]", "\\\\", "a", "[END]", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        escaped = escaper.escape(text)
        assert escaper.unescape(escaped) == text and not any(c in escaped for c in template.all_controls())
    for bad in ("x", "a\\b", "aba"):
        with pytest.raises(ValueError):
            Template(controls=(bad,)).all_controls()


def test_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", "é [INST]"), (2, 0, "user", None), (2, 1, None, "who"), (3, 0, "system", ""), (3, 0, "system", ""), (3, None, "user", "first"), (None, 5, "tool", "t"), (4, 0, "judge[/ROLE]", "x<s>\\")]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]  # longer than a batch of segments
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumn("loss", F.lit(1)).withColumn("seq", F.lit("x"))
    got = {r.conv_id: r for r in op2_chat_format(spark, write_tables(spark, tmp_path, conversations=df)).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    by[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)), c
    assert got[-7].valid and got[1].valid and got[9].valid and not got[2].valid and not got[3].valid
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_order_of_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (3, 0, "assistant", "a")]
    faults = {r.conv_id: r.fault for r in read_back(format_conversations(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    assert faults == {1: "turn 1: user after user", 2: "ends after user", 3: "turn 0: assistant after the start"}


PAGE = """<!doctype html><html><head><title>x</title><script>var a="<p>no</p>"</script><style>p{}</style></head><body class="page has-sidebar">
<header><h1>Site name</h1><p>A tag line of the site which is quite long and has many words in it indeed</p></header><nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav>
<div id="cookie-notice" class="cookieBanner"><p>We use cookies and a lot of words to tell you about that, please accept them all now.</p></div>
<main><article class="post"><header class="entry-header"><h1>Real &amp; title</h1></header><!-- <p>gone</p> --><p>First   para &#233; &nbsp; with <a href=x>link</a>.</p><div class="advert">Buy this thing now</div>
<ul><li>one<li>two</ul><P>One<br>word<p>Last<aside>side note long long</aside></article>
<section id="comments"><h2>Comments</h2><p>A reader said many many words about this article and then some more words too.</p></section></main>
<form><p>Name</p><input><textarea>foo</textarea></form><footer>(c) me</footer></body></html>"""


def test_pages(spark, tmp_path):
    assert main_text(PAGE) == "Real & title\nFirst para é with link.\none\ntwo\nOne word\nLast"
    long = "<article>" + "<p>word</p>" * 20_000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>cut &am"), (5, "u", "<article><p>cut <a hre"), (6, "u", "no markup"), (7, "u", long), (7, "u", long), (None, "u", "<article>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in op4_html_text(spark, write_tables(spark, tmp_path, pages=df)).collect()]
    want = [(1, main_text(PAGE)), (2, ""), (3, ""), (4, "cut &am"), (5, "cut"), (6, ""), (7, "\n".join(["word"] * 20_000)), (7, "\n".join(["word"] * 20_000)), (None, "x")]
    assert sorted(got, key=str) == sorted([(i, t, len(t)) for i, t in want], key=str)


def test_pages_without_article():
    page = "<div id=menu><a href=1>Home</a> <a href=2>News</a></div><table><tr><td><p>This paragraph is long enough to count as text, with many words in it, for sure.<p>Short one.<p>Another paragraph that is long enough to count as text, with many words in it.</td></tr></table><div><a href=1>About</a> | <a href=2>Contact</a></div>"
    assert main_text(page).split("\n")[1] == "Short one." and "About" not in main_text(page) and "Home" not in main_text(page)


def test_broken_markup():
    assert main_text("<article><p class=x>one <a href=\"two>three</a> four") == "one three four"
    assert main_text("<article><p>a < b <3 & c &lt;p&gt;") == "a < b <3 & c <p>"
    assert main_text("<article><p title='a > b'>x</p></nav></p>y</article>z") == "x\ny"
    many = "<article><p>" + "<a href=\"" * 3000 + "end"
    assert main_text(many).startswith("") and len(main_text(many)) < len(many)


def test_long_attributes():
    long = "{'a': '<p>b</p>'} > " * 2000
    assert main_text(f'<article><p>one<script data-x="{long}">var x;</script><iframe srcdoc="{long}">no</iframe></p><div class=sidebar data-props="{long}"><p>menu</div><p>two</article>') == "one\ntwo"
    long = long.replace("'", '"')
    assert main_text(f"<article><p>one<nav data-x='{long}'>menu</nav><p title='{long}'>two</article>") == "one\ntwo"


def test_unbalanced_quotes_take_linear_time():
    for part in ("<a \"x>\" ", "<a '>\"", "<a href=\"", "<a \"'>' ", "<a '\" \"' b", "<a\"'"):
        start, tags, at = time.perf_counter(), Tags(part * 50_000), 0
        while found := tags.next(at):
            at = found[1]
        assert time.perf_counter() - start < 20, part


#: Pages whose blocks begin with + if they are main text and with - if not.
LABELLED = [
    """<table><tr><td><a href=1>-Home</a> <a href=2>News</a> <a href=3>Sport</a></td></tr><tr><td><a href=4>-Log on</a> | <a href=5>Help</a></td></tr>
    <tr><td><p>+The council met on Monday and voted, after a long debate, for the new bridge over the river at the old mill.<p>+It will open in May.<p>+Work on both banks begins as soon as the water is low enough,
    which engineers expect for the end of the summer at the latest.</td></tr><tr><td><a href=6>-About us</a> <a href=7>Contact</a></td></tr><tr><td><a href=8>-Terms</a> <a href=9>Privacy</a></td></tr></table>""",
    """<div class=x1><div><a href=1>-Start</a></div><div><a href=2>-Archive</a></div><div><a href=3>-Authors</a></div></div><div class=x2><h2>+A short walk</h2><div>+We set out before dawn with nothing but bread and water, and
    reached the pass when the sun stood high above the valley and the lake.</div><div>+From there the way leads down through larch woods to a hut where hikers can sleep for little money, if they have asked before.</div></div>
    <div class=x3><div><a href=4>-Imprint</a></div><div><a href=5>-Back to the top</a></div></div>""",
    """<article><h1>+Bread</h1><ul><li><a href=#a>-Flour</a></li><li><a href=#b>-Water</a></li><li><a href=#c>-Salt and yeast</a></li></ul><p>+Flour differs by mill and by year, so take the amounts for a start only.</p><p><a href=x>+The long version</a></p>
    <p>+Knead <a href=y>slowly</a>.</p><h2>+Salt</h2><ul><li>+two spoons</li><li>+a pinch of sugar</li></ul><p>+Bake it hot.</p><div><a href=1>-Rolls</a></div><div><a href=2>-Cakes</a></div><div><a href=3>-Pies</a></div></article>""",
    """<main><p>+One line.</p><section><p>+A second one with a few more words in it.</p><p>+Third.</p></section><p>+See <a href=1>this page and that one</a> for more on it.</p><ul><li><a href=1>-Older posts</a></li><li><a href=2>-Newer posts</a></li></ul></main>
    <div id=comments><p>-I have read this with joy and would like to say that, of all that was ever written on this matter, it is the best by far.</p></div>""",
    """<body><nav><a href=1>-Up</a></nav><p>+Here is a text that nobody has marked in any way at all, but which goes on for more than a dozen words.</p><pre>+and code that
    belongs to it</pre><p>+It ends with a sentence of a good length, so that nobody takes it for a line of a menu or the like.</p><div>-<a href=1>Tags</a>: <a href=2>life</a>, <a href=3>work</a></div><div><a href=4>-Next</a></div><footer>-All rights reserved</footer></body>""",
    """<div><a href=1>-Home</a></div><div>-Weather and traffic</div><div><a href=2>-Maps</a></div><div>+The storm that crossed the coast on Friday night has left eleven villages without power, and crews from three
    counties are on their way.</div><div><a href=3>-More</a></div><div>-Service hotline</div><div><a href=4>-Call us</a></div><div>-Our newsletter</div><div><a href=5>-Read it</a></div>""",
]


_FIRST = "The ferry that links the two islands will run again from Saturday, after engineers replaced both of its engines in a dry dock up the coast."
_SECOND = "Tickets cost as much as before the repair, and the first boat leaves at six in the morning, an hour earlier than in past summers, said the harbour master."
_THIRD = "Cars must be booked two days ahead, since the smaller deck takes only thirty of them, while people on foot can board until the last minute."
_BODY = f"<h1>+Ferry runs again</h1><p>+{_FIRST}</p><p>+{_SECOND}</p><h2>+What it costs</h2><p>+{_THIRD}</p>"
_MENU = "<ul><li><a href=1>-Home</a></li><li><a href=2>-Islands</a></li><li><a href=3>-Weather</a></li></ul>"
_REMARK = "<p>-I have taken this boat for twenty years, and never once was it late, whatever the weather and the season, so thank you.</p><p>-Same here.</p>"
#: Frames with classes that also name what is beside an article; comments and notices that nothing names.
FRAMED = [
    f"<body class='single has-sidebar'><nav>{_MENU}</nav><div class='content has-sidebar'>{_BODY}</div><div class=sidebar><p>-{_THIRD}</p></div></body>",
    f"<div class='post type-post category-social tag-legal'>{_BODY}</div><div class='widget_recent'><p>-Recent news from the islands and beyond</p></div><footer><p>-{_FIRST}</p></footer>",
    f"<div id=page class='site left-sidebar'><div id=masthead>-Island News, since 1911, in all weathers</div><article>{_BODY}</article><div class='comments-area'>{_REMARK}</div></div>",
    f"<div class='wrapper sticky-nav'>{_MENU}<main>{_BODY}</main><div class=related><p>-The lighthouse keeper who never saw the sea at night</p></div></div>",
    f"<form id=aspnetForm><div class=topbar>{_MENU}</div><div class=content>{_BODY}</div><div class=newsletter><p>-Get our best stories by post each week</p></div></form>",
    f"<div>{_MENU}</div><div>{_BODY}<h3>-3 comments</h3>{_REMARK}</div><p>-We use cookies to make this site work; by reading on you accept them, or see our privacy page for more.</p>",
    f"<div class=x7><a href=1>-Start</a> <a href=2>Map</a></div><div class=x8>{_BODY}<div class=x9><p>-2 readers wrote</p>{_REMARK}</div></div><div>-© 2021 Island News, a paper of the people</div>",
    f"<section class='layout-with-sidebar page'><section>{_BODY}</section><section><h2>-Comments</h2>{_REMARK}</section></section><p>-Wir verwenden Cookies. Näheres steht unter Datenschutz, wo sich auch einstellen lässt, was nötig ist.</p>",
    f"<div class=remarks>{_REMARK}</div><article class='entry format-aside'>{_BODY}</article><p>-All rights reserved, also in part, by the paper and those who write for it.</p>",
    f"<div class='row no-footer'><div class='story tag-comments'>{_BODY}<p>+Nobody who wants to go has to wait for long.</p></div><aside><p>-{_SECOND}</p></aside></div><div>{_MENU}</div>",
]


def shown(*features):
    """(right main blocks, wrong ones, missed ones) over the framed pages, with these features hidden from the tree."""
    right = wrong = missed = 0
    for page in FRAMED:
        labels = [b.text[0] == "+" for b in blocks_of(page)]
        blocks = blocks_of(re.sub(r"(?<=>)[+-]", "", page))
        for main, row in zip(labels, described(blocks), strict=True):
            said = default_tree().is_text(tuple(0 if name in features else x for name, x in zip(FEATURES, row)))
            right, wrong, missed = right + (main and said), wrong + (said and not main), missed + (main and not said)
    return right, wrong, missed


def test_frames_are_not_what_their_classes_name():
    for features, least in (((), 0.98), (("aside", "article"), 0.9), (("notice", "remarks"), 0.85)):
        right, wrong, missed = shown(*features)
        assert 2 * right / (2 * right + wrong + missed) >= least and right / (right + missed) >= 0.95, features
    assert shown("notice", "remarks")[1] > shown()[1] < shown("aside", "article")[1]


def test_what_a_page_is_called_does_not_count():
    two = "<p>" + " ".join(["word"] * 24) + "</p><p>" + " ".join(["term"] * 24) + "</p>"
    for page in ("<div class='content has-sidebar'>{}</div>", "<div class='post type-post category-social tag-legal'>{}</div>", "<div id=page class='site left-sidebar'><article>{}</article></div>", "<div class='wrapper sticky-nav'><main>{}</main></div>", "<form id=aspnetForm><div class=content>{}</div></form>"):
        assert main_text(f"<nav><a href=1>Home</a></nav>{page.format(two)}<div class=sidebar><p>Some note</p></div>").count("\n") == 1, page
    # Comments that are longer than the article stay comments, in articles of their own too.
    many = f"<div class='comments-area'>{'<article class=comment-body>' + two + '</article>' * 4}</div>"
    assert main_text(f"<article>{two}</article>{many}").count("\n") == 1
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p><p>All rights reserved.</p></article>") == "Let x=2 be.\nAll rights reserved."
    assert main_text(f"<h1>T</h1><p>3 comments</p>{two}").count("term") == 24  # a line below the title announces nothing


def judged(feature_off=()):
    """(right main blocks, wrong ones, missed ones) over the labelled pages, with a tree that sees nothing of some features."""
    blind = lambda row: tuple(0 if name in feature_off else x for name, x in zip(FEATURES, row))
    tree = grow([(*blind(row[:-1]), row[-1]) for row in labelled_rows()])
    right = wrong = missed = 0
    for page in LABELLED:
        blocks = blocks_of(page)
        for block, row in zip(blocks, described(blocks)):
            main, said = block.text.startswith("+"), tree.is_text(blind(row))
            right, wrong, missed = right + (main and said), wrong + (said and not main), missed + (main and not said)
    return right, wrong, missed


def test_blocks_of_labelled_pages():
    right, wrong, missed = judged()
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95


def test_links_and_neighbours_matter():
    for off in (("links", "links_before", "links_after"), ("words", "words_before", "words_after"), ("links_before", "links_after", "words_before", "words_after")):
        right, wrong, missed = judged(off)
        assert wrong + missed >= 1 + sum(judged()[1:]), off


def test_text_goes_on_behind_inline_asides():
    assert main_text("<article><p>Alpha beta gamma <span class='ad'>Buy now</span> delta epsilon zeta.</p>") == "Alpha beta gamma delta epsilon zeta."
    assert main_text("<article><p>Alpha <button>Share <b>it</b></button> delta</p><p>last") == "Alpha delta\nlast"
    assert main_text("<article><div>one <span class=ad>x<div>y</div></span> two</div>three") == "one\ntwo\nthree"
    assert main_text("<article><p>one <span class=ad>open</p><p>two <span class=ad>open") == "one\ntwo"


def test_deep_nesting_takes_linear_time():
    start = time.perf_counter()
    for part in ("<b>", "<div>", "<b></i>", "<li><b>", "<span class=ad>", "<p><span class=ad>x", "<span class=ad><div>x", "<div class=ad>x", "<h3>3 comments</h3>", "<form><main>"):
        main_text("<article>" + part * 30_000)
    assert time.perf_counter() - start < 60


def test_tree_fits_its_table():
    tree = default_tree()
    assert all(tree.is_text(row[:-1]) == bool(row[-1]) for row in labelled_rows())


def good(rng):
    return " ".join(rng.choice(["river", "apple", "orange", "cable", "window", "The", "magnet.", "of", "to"]) for _ in range(rng.randint(20, 90)))


def bad(rng):
    return " ".join(rng.choice(["BUY!!", "NOW!!", "###", "CLICK***", "$$$"]) for _ in range(rng.randint(20, 90)))


def test_quality(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(400)] + [(1000, None), (1001, ""), (1002, good(rng) * 300), (None, good(rng))]
    labels = [(i, int(i % 4 != 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (1000, 1, 0), (7, 1, 1)]
    folder = write_tables(spark, tmp_path, documents=spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in op1_quality(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, _ in docs[:400]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 4 != 0) and 0 <= got[i].score <= 1
    assert got[1000].score == got[1001].score and got[1002].predicted == 1


def test_quality_never_learns_from_held_out_rows(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, good(rng) if i % 2 else bad(rng)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = fit(docs, labels), fit(docs, flipped)
    assert (one.weights == two.weights).all() and one.curve == two.curve


TABLES = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")
def test_quality_of_held_out_rows(spark):
    """Real labels that the model never saw."""
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").where("quality IS NOT NULL")
    rows = op1_quality(spark, str(TABLES)).where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    low, high = ([r.score for r in rows if r.quality == q] for q in (0, 1))
    ordered = sum((b > a) + 0.5 * (b == a) for a in low for b in high) / (len(low) * len(high))
    assert len(rows) > 40 and ordered > 0.95 and sum(r.quality == r.predicted for r in rows) >= 0.9 * len(rows)


def test_quality_with_repeated_ids(spark):
    """The model is the same whatever the order of rows and their partitions."""
    rng = random.Random(11)
    rows = [(i % 200, good(rng) if i % 2 else bad(rng)) for i in range(600)]
    labels = [(i, i % 2) for i in range(200)] + [(3, 0), (3, 1)]
    models = []
    for n in (1, 7):
        rng.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        models.append(fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), max_labels=100))
    assert (models[0].weights == models[1].weights).all() and models[0].curve == models[1].curve


def test_features_in_slices(monkeypatch):
    rng = random.Random(3)
    texts = pa.array(["".join(rng.choice("aab B1 .!\nc\u00e9") for _ in range(rng.randint(0, 60))) for _ in range(100)] + ["a a a a b b " * 9])
    whole = [Indicators(texts).of(i) for i in range(len(texts))]
    for size in (7, 8, 13):
        monkeypatch.setattr(quality, "SLICE", size)
        sliced = Indicators(texts)
        assert all((sliced.of(i) == w).all() for i, w in enumerate(whole))
    assert all((unpacked(packed(w)) == w).all() for w in [*whole, range(9000)] for w in [np.array(w)])


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score(docs, fit(docs, none)).first().score == 0.5
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert fit(docs, ones).score(pa.array(["x", None])).tolist() == [1.0, 1.0]
