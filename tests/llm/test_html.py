"""Html text on layouts whose markup the labelled pages don't have, odd markup, and edge cases."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import html_text

LONG = "<p>" + "lorem ipsum dolor " * 12 + "</p><p>" + "sit amet elit " * 14 + "</p>"
TEXT = ("lorem ipsum dolor " * 12).strip() + "\n" + ("sit amet elit " * 14).strip()
#: Pages with names and an order that the labelled pages lack. A line is labelled as there.
UNSEEN = """
== magazine
0|<div class="page-top"><a href=/>The Weekly</a> <span>Ideas for the week</span></div>
0|<div class="topics"><a href=a>Science</a><a href=b>Arts</a><a href=c>Money</a><a href=d>Games</a></div>
 |<section class="longread"><div class="longread-inner">
1|<h1>What the river took, and what it gave back to us</h1>
1|<p>When the water went down the people of the lower town found that the old market hall had moved by almost a metre, walls and roof and all.</p>
1|<p>Nobody was hurt.</p>
1|<p>It took three years, and <a href=x>two inquiries</a>, to learn why: the hall had never been built on stone, but on a raft of oak beams that the builders had sunk in the mud.</p>
1|<h3>A raft of oak</h3>
1|<p>Oak that is kept wet and dark does not rot. The beams were as hard as on the day on which they were laid, and so the hall had simply floated.</p>
 |</div></section>
0|<div class="more-stories"><ul><li><a href=e>How to bake with rye</a></li><li><a href=f>The last lamplighter</a></li><li><a href=g>Ten walks by the sea</a></li></ul></div>
0|<div class="legal">The Weekly is published on Fridays</div>
== forum
0|<ul class="crumbs"><li><a href=a>Forum</a></li><li><a href=b>Garden</a></li></ul>
 |<table class="layout"><tr>
0|<td class="left"><a href=c>New</a><br><a href=d>Old</a><br><a href=e>Rules</a></td>
 |<td class="mid">
1|<h1>Why do my tomatoes split just before they are ripe?</h1>
1|<p>I water them every evening, and they look fine until the skin turns orange. Then nearly every one of them splits from the stalk down.</p>
1|<p>They stand in the sun from noon on, and the soil is heavy. Is it the water, the heat, or the sort that I chose this year?</p>
0|<div id="comments"><p>Mine do the same, I think that it is the water and not the heat, as those in the shade split too.</p><p>Pick them a day early.</p></div>
 |</td></tr></table>
== shop
0|<form action=/find><label>Find</label><input name=q></form>
0|<div class="dept"><a href=a>Lamps</a> <a href=b>Chairs</a> <a href=c>Rugs</a></div>
 |<div itemprop="articleBody">
1|<h2>Oil lamp of brass</h2>
1|<p>A lamp after a pattern from the coast, with a wick that can be turned, a glass that keeps the wind off, and a base wide enough for a boat.</p>
1|<ul><li>Height: 31 cm</li><li>Weight: 900 g</li><li>Burns 12 hours</li></ul>
 |</div>
0|<div class="social-bar"><a href=d>Share</a> <a href=e>Mail</a></div>
0|<footer><p>We send to all countries but not to islands</p></footer>
== old page
0|<center><a href=/>Home</a> - <a href=a>Up</a> - <a href=b>Next</a></center><hr>
1|<h1>Notes on mending a clock</h1>
1|<p>Take out the pendulum first. If you forget it, the spring that holds it will bend, and such springs are no longer made in the size that is needed here.</p>
1|<p>Then let down the main spring, click by click, with the key held firmly, since all that is stored in it wants to come out at once.</p>
1|<p>Now the hands can be pulled.</p>
1|<p>Clean the plates with chalk and spirit. Never use water, and never touch the pivots with anything harder than a stick of pegwood that you have sharpened.</p>
0|<hr><center><a href=a>Up</a> - <a href=b>Next</a></center>
== news in boxes
0|<header role="banner"><a href=/>City Post</a></header>
0|<nav class="nav"><ul><li><a href=a>Town</a></li><li><a href=b>Land</a></li></ul></nav>
 |<main><div class="grid"><article>
1|<h1>Trams stand still on Monday</h1>
1|<p>All lines stop from four in the morning, the works council said.</p>
0|<div class="advert"><p>Buy one lamp and get the second at half the price, this week alone</p></div>
1|<p>Buses go instead, if the drivers who live across the river get to town, which is by no means sure as the bridge is shut.</p>
0|<div class="share"><a href=s>Post</a></div>
1|<p>Schools open at nine.</p>
 |</article>
0|<aside><h2>Most read</h2><ol><li><a href=c>A cat in court</a></li><li><a href=d>The mill burns</a></li></ol></aside>
 |</div></main>
0|<section id="disqus_thread"><p>They could have said so a week ago and not on a Sunday night when everybody is asleep already.</p></section>
0|<footer>City Post, 1 Market Square</footer>
"""


def lines_of(page):
    text, lines = "<html><body>", []
    for line in page.splitlines()[1:]:
        lines.append((len(text), -1 if line[0] == " " else int(line[0])))
        text += line[2:] + "\n"
    return text, lines


def test_blocks_of_unseen_layouts():
    right = total = 0
    for page in UNSEEN.split("\n== ")[1:]:
        text, lines = lines_of(page)
        starts = [a for a, _ in lines]
        for b, row in zip(*html_text.described(html_text.parse(text)), strict=True):
            label = lines[int(np.searchsorted(starts, b.start, "right")) - 1][1]
            total += 1
            right += html_text.trained().says(row) == bool(label)
    assert total >= 50 and right >= 0.95 * total, (right, total)


@pytest.mark.parametrize(
    "page",
    ['<body class="has-sidebar">@', '<body class="post tags-open has-sidebar"><article>@</article>', '<div class="left side content">@</div>', '<div class="left content">@</div>',
     "<form id=f><article>@</article></form>", '<form method="post"><div class="c1">@</div></form>', '<div class="sidebar-wrap"><div class="widget">@</div></div>',
     '<div class="page right-sidebar"><article>@</article></div>', "<p data-x=it's title='>'></p>@", "<div>@", "@", "<main>@</main><div hidden><main><p>Not to be seen at all</p></main></div>"],
)
def test_a_page_around_the_article_drops_none_of_it(page):
    assert html_text.main_text(page.replace("@", LONG)) == TEXT


def test_a_headline_or_a_box_with_a_good_name_is_not_all():
    assert html_text.main_text(f'<div class="entry-title"><h1>The headline</h1></div><div class="c1">{LONG}</div>') == f"The headline\n{TEXT}"
    assert TEXT in html_text.main_text(f'<div class="c1">{LONG}</div><div class="text"><p>Box of few words here</p></div>')


def test_short_paragraphs_in_a_plain_container():
    lines = [f"Short line number {i} of this text." for i in range(6)]
    assert html_text.main_text("<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>") == "\n".join(lines)


def test_apostrophes_in_values_without_quotes():
    assert html_text.main_text(f"<p data-x=it's>{'these words don’t end, don' + chr(39) + 't they? ' * 6}</p>").startswith("these words")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 8000 + "</span>" * 8000 + "</b>" * 8000, "<div><span>" * 8000 + "</p>" * 8000, "<p>" * 20000, "<ul><li>" * 8000 + "</ul>" * 8000, '<a b="' * 20000,
     "<td>" * 9000 + "</table>" * 9000, "<p =====a" * 9000, "<!--" * 20000, "<b title='" * 9000],
)
def test_deep_and_broken_markup_takes_little_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 3


def test_nulls_repeats_clashes_and_an_empty_table(spark):
    rows = [(1, None, "mine"), (2, "", "mine"), (3, LONG, "mine"), (3, LONG, "mine"), (None, "<article><p>" + "long " * 300_000, "mine")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("_html", F.lit("own"))
    found = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars, r["_html"]) for r in found) == [
        ("1", 0, "own"), ("2", 0, "own"), ("3", len(TEXT), "own"), ("3", len(TEXT), "own"), ("None", 5 * 300_000 - 1, "own")
    ]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_text_of_the_tables_is_their_articles(spark):
    """Brute force for the markup of the tables: what stands between the article's tags."""
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(x for x in parts if x)


NAV = "<div><a href=a>Home</a> <a href=b>News</a> <a href=c>More things</a></div>"
FOOT = "<footer>Copyright nineteen ninety nine by us all</footer>"
WORDS = " ".join(f"w{i}" for i in range(19))
KINDS = [("<section>", "</section>"), ("<div>", "</div>"), ("<article>", "</article>"), ("<div class=k@>", "</div>"), ("<tr><td>", "</td></tr>"),
         ("<div class=row><div class=col>", "</div></div>")]


@pytest.mark.parametrize(("open_", "close"), KINDS)
@pytest.mark.parametrize(("start", "end"), [("", ""), ("<main>", "</main>"), ("<div class=content>", "</div>")])
def test_an_article_in_any_number_of_containers_loses_no_block(open_, close, start, end):
    """1 to 40 of each kind, with headlines or without, with a main headline or without; what is around it goes."""
    for n in range(1, 41):
        for title in ("", "<h1>The big headline</h1>"):
            for heads in (True, False):
                body, want = [], ["The big headline"] if title else []
                for i in range(n):
                    text = f"p{i} {WORDS}" + (" words here" if n % 2 else "")
                    want += [f"S{i} head", text] if heads else [text]
                    body.append(f"{open_.replace('@', str(i))}{f'<h2>S{i} head</h2>' if heads else ''}<p>{text}</p>{close}")
                table = ("<table>", "</table>") if open_.startswith("<tr") else ("", "")
                page = f"<html><body>{NAV}{start}{title}{table[0]}{''.join(body)}{table[1]}{end}{FOOT}</body></html>"
                assert html_text.main_text(page).split("\n") == want, (n, title, heads)


@pytest.mark.parametrize(
    "line", ['<p class="share-price">The price of a share rose</p>', '<p class="side">Both of the sides agreed</p>', "<blockquote>To be short</blockquote>", "<figure><figcaption>Berlin</figcaption></figure>"]
)
def test_lines_with_odd_names_or_few_words_stay(line):
    page = f"<body>{NAV}<article><h1>Head</h1><p>{WORDS}</p>{line}<p>{WORDS}</p></article>{FOOT}"
    assert html_text.main_text(page).split("\n")[2:3] == [html_text.re.sub("<[^>]+>", "", line)]


def test_words_and_links_of_a_block_and_its_neighbours_carry_the_tree():
    """Their part of what the splits of the tree gain, and that no split takes text away for more of the article."""
    x, y = html_text.labelled_blocks()
    gain = np.zeros(x.shape[1])
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0

    def walk(node, x, y):
        if node.column >= 0:
            low = x[:, node.column] <= node.at
            gain[node.column] += impurity(y) - impurity(y[low]) - impurity(y[~low])
            assert node.column not in html_text.RISING or y[low].mean() <= y[~low].mean()
            walk(node.low, x[low], y[low])
            walk(node.high, x[~low], y[~low])

    walk(html_text.trained(), x, y)
    beside = [html_text.FEATURES.index(f) for f in ("before_words", "before_link", "after_words", "after_link")]
    assert gain[sorted(html_text.FLAT_FEATURES)].sum() > 0.5 * gain.sum() and gain[beside].sum() > 0.1 * gain.sum()
