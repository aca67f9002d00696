"""Labelled pages for the block classifier of html_text, and the rules that vary them.

A page is a few lines of markup, each labelled by hand: 1 if the text that starts in it is text of the
article, 0 if it isn't, and a space if it holds no text. {n} stands for n words.
"""

from __future__ import annotations

import re

import numpy as np

PAGES = """
== newspaper
0|<header><h1><a href=/>{2}</a></h1><p>{6}</p></header>
0|<nav><ul><li><a href=1>{1}</a><li><a href=2>{1}</a><li><a href=3>{2}</a><li><a href=4>{1}</a></ul></nav>
 |<article class="story">
1|<h1>{9}</h1>
1|<p class="standfirst">{22}</p>
0|<div class="share-tools"><a href=s>{1}</a> <a href=t>{1}</a></div>
1|<p>{58} <a href=x>{3}</a> {12}</p>
1|<h2>{4}</h2>
1|<p>{41}</p>
1|<p>{7}</p>
1|<figure><img src=i><figcaption>{1}</figcaption></figure>
1|<blockquote>{5}</blockquote>
1|<blockquote><p>{19}</p></blockquote>
1|<p>{36}</p>
0|<aside><h3>{2}</h3><p>{17}</p></aside>
1|<p>{49}</p>
 |</article>
0|<section class="comments"><h2>{2}</h2><div><p>{33}</p><p>{12}</p><p>{51}</p></div></section>
0|<footer><p>{14}</p><ul><li><a href=5>{2}</a><li><a href=6>{1}</a></ul></footer>
== weblog
0|<div id="header"><a href=/>{3}</a><p>{8}</p></div>
0|<div id="menu"><a href=1>{1}</a> <a href=2>{1}</a> <a href=3>{1}</a></div>
 |<div id="content"><div class="post">
1|<h2>{6}</h2>
1|<div class="entry-content"><p>{44}</p>
1|<p>{3}</p>
1|<ul><li>{9}</li><li>{5}</li><li>{13}</li></ul>
1|<p>{63}</p>
1|<p>{8} <a href=x>{4}</a></p></div>
0|<div class="meta">{3} <a href=t>{1}</a>, <a href=u>{1}</a></div>
 |</div></div>
0|<div id="sidebar"><h3>{2}</h3><ul><li><a href=4>{5}</a><li><a href=5>{6}</a></ul><p>{26}</p></div>
0|<div id="respond"><form><p>{11}</p><label>{1}</label></form></div>
0|<div id="footer">{9}</div>
== plain
0|<p><a href=/>{1}</a> | <a href=1>{1}</a> | <a href=2>{2}</a></p>
 |<div class="c1">
1|<h1>{5}</h1>
1|<p>{31}</p>
1|<p>{55}</p>
1|<p>{12}</p>
1|<p>{70}</p>
 |</div>
0|<div class="c2"><a href=3>{3}</a><br><a href=4>{4}</a><br><a href=5>{3}</a></div>
0|<p>{8}</p>
== short lines
0|<div class="c0"><a href=1>{1}</a> <a href=2>{1}</a> <a href=3>{1}</a></div>
 |<div class="c1">
1|<h2>{3}</h2>
1|<p>{7}</p>
1|<p>{5}</p>
1|<p>{8}</p>
1|<p>{6}</p>
1|<p>{9}</p>
1|<p>{4}</p>
 |</div>
0|<div class="c2"><a href=4>{2}</a> <a href=5>{2}</a></div>
== teasers beside a text without marks
0|<ul><li><a href=1>{1}</a></li><li><a href=2>{1}</a></li><li><a href=3>{1}</a></li></ul>
 |<div class="k"><div class="k1">
1|<h1>{7}</h1>
1|<p>{39}</p>
1|<p>{48}</p>
1|<p>{27}</p>
 |</div></div>
0|<div class="k2"><h3><a href=4>{6}</a></h3><p>{9} <a href=4>{2}</a></p>
0|<h3><a href=5>{5}</a></h3><p>{11} <a href=5>{2}</a></p>
0|<h3><a href=6>{7}</a></h3><p>{8} <a href=6>{2}</a></p></div>
0|<div>{7}</div>
== table layout
 |<table><tr>
0|<td><a href=1>{1}</a><br><a href=2>{2}</a><br><a href=3>{1}</a></td>
 |<td>
1|<b>{4}</b><p>
1|{66}<p>
1|{52}<p>
1|{14}
0|</td><td><font>{5} <a href=4>{3}</a></font></td>
 |</tr></table>
0|<center>{6} <a href=5>{2}</a></center>
== recipe
0|<div class="topbar"><a href=/>{1}</a> {2}</div>
 |<main>
1|<h1>{4}</h1>
1|<p>{21}</p>
1|<h2>{1}</h2>
1|<ul><li>{3}</li><li>{2}</li><li>{4}</li><li>{2}</li><li>{5}</li></ul>
1|<ol><li>{16}</li><li>{23}</li><li>{12}</li></ol>
0|<div class="newsletter"><p>{12}</p></div>
1|<p>{9}</p>
 |</main>
0|<div class="related"><h2>{3}</h2><ul><li><a href=1>{4}</a></li><li><a href=2>{5}</a></li></ul></div>
0|<footer>{5}</footer>
== questions
0|<header><a href=/>{2}</a></header>
 |<div class="main-content">
1|<h1>{3}</h1>
1|<dl><dt>{9}</dt><dd>{31}</dd><dt>{7}</dt><dd>{24}</dd><dt>{11}</dt><dd>{46}</dd></dl>
1|<p>{6} <a href=c>{2}</a></p>
 |</div>
0|<div class="cookie-banner"><p>{28}</p><a href=y>{1}</a></div>
== documentation with a list of links in it
0|<nav><a href=1>{1}</a><a href=2>{1}</a></nav>
 |<main>
0|<ul><li><a href=3>{2}</a></li><li><a href=4>{3}</a></li><li><a href=5>{1}</a></li><li><a href=6>{2}</a></li></ul>
1|<h1>{2}</h1>
1|<p>{18}</p>
1|<pre>{26}</pre>
1|<p>{4}</p>
1|<table><tr><td>{1}</td><td>{12}</td></tr><tr><td>{1}</td><td>{9}</td></tr></table>
1|<p>{37} <a href=7>{6}</a></p>
 |</main>
0|<aside><p>{31}</p></aside>
== page-wide form
 |<form id="aspnetForm">
0|<div class="banner"><a href=/>{2}</a></div>
0|<div><a href=1>{1}</a><a href=2>{2}</a><a href=3>{1}</a></div>
1|<div class="body"><h1>{6}</h1><p>{47}</p>
1|<p>{29}</p><p>{6}</p></div>
0|<div class="login"><label>{1}</label><label>{1}</label><p>{5}</p></div>
0|<div class="copyright">{8}</div>
 |</form>
== a long discussion under a short text
0|<div class="nav"><a href=1>{1}</a> <a href=2>{1}</a></div>
 |<div class="q">
1|<h1>{8}</h1>
1|<div>{35}</div>
1|<p>{16}</p>
 |</div>
0|<ol class="commentlist"><li>{44}</li><li>{71}</li><li>{9}</li><li>{38}</li></ol>
0|<div>{4} <a href=3>{2}</a></div>
== many sections
0|<div class="site-header"><span>{2}</span><ul><li><a href=1>{1}</a></li><li><a href=2>{1}</a></li></ul></div>
1|<div class="s0"><h1>{5}</h1><p>{20}</p></div>
1|<div class="s1"><h2>{3}</h2><p>{33}</p><p>{11}</p></div>
1|<div class="s2"><h2>{2}</h2><p>{25}</p><p>{42}</p></div>
1|<div class="s3"><h2>{4}</h2><p>{14}</p><p>{52}</p></div>
0|<div class="s4"><h2>{2}</h2><a href=3>{5}</a><a href=4>{4}</a><a href=5>{6}</a></div>
0|<div class="s5"><p>{6}</p><p><a href=6>{1}</a> <a href=7>{1}</a></p></div>
== bare text
1|<p>{40}</p>
== bare text with a headline
1|<h1>{6}</h1>
1|<div>{24}</div>
1|<div>{51}</div>
== bare lines
1|<p>{12}</p><p>{27}</p><p>{8}</p>
== short articles
1|<article><h1>{3}</h1><p>{6}</p></article>
== articles with a head
1|<article><header><h1>{2}</h1></header><p>{6}</p></article>
== article with a head and lines
0|<header><a href=/>{2}</a></header>
 |<main><article>
1|<header><h1>{4}</h1><p>{3}</p></header><p>{23}</p><p>{2}</p>
 |</article></main>
0|<footer>{6}</footer>
== short article alone
1|<main><p>{5}</p></main>
== short article with a side
1|<article><p>{6}</p></article>
0|<div id="sidebar"><p>{50}</p></div>
== short article with notes
0|<nav><a href=1>{1}</a></nav>
1|<article><h1>{2}</h1><p>{4}</p></article>
0|<aside><p>{30}</p></aside>
0|<div class="c9"><p>{4}</p></div>
== lines in an article
0|<div class="c2"><p>{7}</p></div>
1|<article><p>{6}</p><p>{3}</p><p>{1}</p><p>{9}</p></article>
0|<div class="c3"><p>{5}</p></div>
== a headline apart
1|<div class="s0"><h1>{3}</h1></div>
1|<div class="c1"><p>{36}</p><p>{42}</p></div>
== a headline apart and parts of the text
1|<div class="s0"><h1>{5}</h1><p>{18}</p></div>
1|<div class="c1"><p>{36}</p><p>{21}</p></div>
1|<div class="c2"><p>{40}</p><p>{15}</p><p>{33}</p></div>
== a word alone
0|{1}
== small boxes beside the text
0|<div class="b0"><p>{4}</p></div>
1|<div class="c1"><p>{45}</p><p>{38}</p><p>{9}</p></div>
0|<div class="text"><p>{6}</p></div>
0|<div class="b1"><p>{9}</p><p><a href=1>{3}</a></p></div>
== boxes after many sections
0|<div class="b2">{3}</div>
1|<section><h2>{4}</h2><p>{30}</p></section><section><h2>{3}</h2><p>{44}</p><p>{7}</p></section>
0|<div class="b3"><p>{5}</p></div>
== short lines in a page that has more
0|<ul><li><a href=1>{1}</a></li><li><a href=2>{2}</a></li></ul>
1|<div id="c7"><p>{6}</p><p>{9}</p><p>{7}</p><p>{5}</p><p>{8}</p></div>
0|<p>{5}</p>
== links alone
0|<header><h1>{2}</h1></header>
0|<ul><li><a href=1>{2}</a></li><li><a href=2>{4}</a></li><li><a href=3>{3}</a></li><li><a href=4>{7}</a></li></ul>
0|<div><a href=5>{3}</a></div><div><a href=6>{9}</a></div>
0|<footer><p>{12}</p></footer>
== one paragraph
0|<nav><a href=1>{1}</a><a href=2>{1}</a></nav>
1|<article><p>{3}</p></article>
0|<div class="ad">{13}</div>
0|<footer>{9}</footer>
== an item, a note and remarks in an article
0|<nav><a href=1>{1}</a><a href=2>{1}</a></nav>
 |<article>
1|<h1>{4}</h1>
1|<p>{9}</p>
1|<p>{6} <a href=3>{2}</a> {2}</p>
1|<ul><li>{2}</li></ul>
0|<aside>{5}</aside>
0|<div class="comments"><p>{10}</p></div>
 |</article>
0|<div id="sidebar"><p>{14}</p></div>
0|<form><p>{6}</p></form>
0|<footer>{3}</footer>
== notes in an article
 |<article>
1|<h1>{11}</h1>
1|<p>{1}</p>
1|<p>{90}</p>
1|<p><a href=1>{3}</a></p>
1|<p>{64} <a href=2>{11}</a> {4}</p>
1|<p>{2}</p>
0|<div class="promo"><p>{19}</p></div>
1|<p>{33}</p>
1|<p>{5}</p>
 |</article>
0|<div class="x7"><h4>{2}</h4><p>{24}</p></div>
0|<div class="x8">{10}</div>
"""
#: How often each page is varied.
TIMES = 12
#: Marks of an article that other pages lack.
MARK = re.compile(r"<(/?)(?:article|main)\b[^>]*>")
NAME = re.compile(r" (?:class|id)=\"(?:[bcstx]\d|k\d?|q|story|post|body|content|entry-content|main-content|standfirst)\"")


#: Containers of an article, so many, each opened and closed so, in a page that begins and ends so (with their labels).
COUNTS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 30, 40)
CONTAINERS = (
    ("<section>", "</section>"), ("<div>", "</div>"), ("<article>", "</article>"), ('<div class="b0">', "</div>"),
    ("<div><div>", "</div></div>"), ("<tr><td>", "</td></tr>"),
)
AROUND = (
    ("0|<div><a href=1>{1}</a> <a href=2>{1}</a> <a href=3>{2}</a></div>", "", "", "0|<footer>{8}</footer>"),
    ("0|<nav><a href=1>{1}</a><a href=2>{2}</a></nav>", "<main>", "</main>", "0|<aside><p>{14}</p></aside>\n0|<footer><p>{6}</p></footer>"),
    ("0|<ul><li><a href=1>{1}</a></li><li><a href=2>{2}</a></li></ul>", '<div class="content">', "</div>",
     '0|<div class="sidebar"><h3>{2}</h3><p>{20}</p></div>\n0|<div class="x1">{4} <a href=4>{4}</a></div>'),
    ("0|<header><a href=/>{2}</a><p>{4}</p></header>", "", "", "0|<div>{3} <a href=4>{2}</a> <a href=5>{3}</a></div>\n0|<footer>{5}</footer>"),
)


def cut_pages() -> list[str]:
    """Pages whose article is cut into containers: every number, kind and surrounding, with and without headlines."""
    out = []
    for n in COUNTS:
        for k, (open_, close) in enumerate(CONTAINERS):
            for j, (before, start, end, after) in enumerate(AROUND):
                head = (n + k + j) % 3
                rows = open_.startswith("<tr")
                lines = [before, f" |{start}{'<table>' if rows else ''}"]
                if head == 0:
                    lines.append("1|<h1>{6}</h1>")
                for i in range(n):
                    title = "<h2>{2}</h2>" if head < 2 else ""
                    more = "<p>{8}</p>" if (i + j) % 4 == 1 else "<blockquote>{4}</blockquote>" if (i + j) % 8 == 3 else ""
                    lines.append(f"1|{open_}{title}<p>{{19}}</p>{more}{close}")
                out.append("\n".join(["", *lines, f" |{'</table>' if rows else ''}{end}", after]))
    return out


def labelled_pages() -> list[tuple[str, list[tuple[int, int]]]]:
    """Every page with, for each of its lines, the offset it starts at and its label (-1: no text).

    Each of PAGES comes TIMES times, with other numbers of words (a half to twice as many, but for single
    words), every second time without names of its parts, every third time without article and main.
    Each of cut_pages comes once, varied in the same way.
    """
    random, out = np.random.default_rng(3), []
    turns = [(page, turn) for page in PAGES.split("\n== ")[1:] for turn in range(TIMES)]
    turns += [(page, 1 + 2 * (i % 2) * (i % 3 == 0)) for i, page in enumerate(cut_pages())]
    for page, turn in turns:
        text, lines = "<html><body>", []
        for line in page.splitlines()[1:]:
            markup = line[2:]
            if turn % 2:
                markup = NAME.sub("", markup)
            if turn % 3 == 2:
                markup = MARK.sub(r"<\1div>", markup)

            def filled(m: re.Match) -> str:
                n = int(m[1])
                n = n if n < 2 or not turn else max(1, round(n * 2 ** random.uniform(-1, 1)))
                return " ".join("word" for _ in range(n))

            lines.append((len(text), -1 if line[0] == " " else int(line[0])))
            text += re.sub(r"\{(\d+)\}", filled, markup) + "\n"
        out.append((text, lines))
    return out
