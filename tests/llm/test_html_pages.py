"""Pages as the raw web has them: attributes of any name, deep nesting."""

from __future__ import annotations

import random

import pytest

from cinequarry.llm.html_extraction import extract_main_text, main_text, nodes, parse


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'data-state="hidden"', "title='hidden gems'", 'data-role="navigation"', 'data-class="sidebar"', "data-id=cookie", "hidden=false", 'aria-hidden = "false"', 'title="a > b hidden" data-x=hidden/', "data-hidden", "x='role=\"menu\"'"],
)
def test_other_attributes_hide_nothing(attributes):
    for tag in ("article", "div"):
        assert main_text(parse(f"<body><{tag} {attributes}><p>Text</p></{tag}></body>")) == "Text"


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", 'class="x" hidden', 'style="a:b"hidden', "aria-hidden=true", "role='menu'", 'data-x="y" CLASS = "top sidebar"', "id=cookie", 'title="it\'s" hidden', "data-a=1 hidden/"])
def test_own_attributes_set_apart(attributes):
    assert main_text(parse(f"<body><div {attributes}><p>Aside</p></div><p>Text</p></body>")) == "Text"


def test_deep_pages(spark):
    """5,000 unclosed elements on one page; a notice at depth 20 that all pages repeat."""
    inside = "<div>" * 18
    pages = [(i, "http://deep.example.org/a", f"<body>{inside}<div class=teaser7>Always <p>the same</p></div><div>Page {i}</div>") for i in range(6)]
    pages.append((6, "http://deep.example.org/a", "<body>" + "<font class=x>" + "<div>x " * 5_000 + "<article>end"))
    pages.append((7, "http://other.example.org/a", "<div>" * 5_000 + "only"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    assert got == {i: f"Page {i}" for i in range(6)} | {6: "end", 7: "only"}


def test_votes_are_of_the_texts_below():
    """Nodes of equal text vote alike, whatever their place and blocks; others differ."""
    votes = {p: (layout, text) for p, layout, text in nodes(parse("<div id=a>one<p>two</p></div><div id=b>before</div><div id=c><p>one</p><br>two</div><div id=d>one twO</div><div id=e></div><ul><li>one<li>two</ul>"))}
    assert votes["/div#a"] == votes["/div#c"] and votes["/div#a"][1] == votes["/ul"][1] == votes["/ul/li"][1]
    assert len({votes[p][1] for p in ("/div#a", "/div#b", "/div#d", "/div#e")}) == 4
    assert votes["/div#e"] == ("", 0) and votes["/div#a"][0] == "p"


def in_article(inner):
    return main_text(parse(f"<body><nav>Menu</nav><article>{inner}</article></body>"))


def test_article_text_stays():
    for inner in (
        '<div style="overflow:hidden"><p>Body text</p></div>',
        '<p title="hidden gem">Body text</p>',
        '<a href="https://x.org/hidden-valley">Body text</a>',
        '<p class="share-price">Body text</p>',
        '<section id="search-results">Body text</section>',
        '<div id="related-work">Body text</div>',
        "<p title=it's>Body text</p>",
        '<a href="https://x.org/cookie" class="ext">Body <em id=adjective>text</em></a>',
        "Body<!-- a > b --> text<!x>",
        "Body</> text</zzz></div>",
    ):
        assert in_article(inner) == "Body text", inner
    assert in_article("<p title=it's>Hello world. Don't go</p><p>next</p>") == "Hello world. Don't go next"
    assert in_article("a < b <3 c &lt;p&gt; d<") == "a < b <3 c <p> d<"


def test_furniture_goes():
    for inner in ('<article class="comment">x</article>', '<div class="comments-area">x</div>', '<div id="adSlot3">x</div>', '<ul class="social-links"><li>x</ul>', '<p class="cookie-notice">x</p>', '<span class="share-buttons">x</span>', "<div hidden>x</div>", '<section class="related-posts">x</section>', "<form>x</form>", "<svg><text>x</text></svg>"):
        assert in_article(f"Body{inner} text") == "Body text", inner


def test_large_odd_pages_take_linear_time():
    import time

    begun = time.process_time()
    assert main_text(parse("<p>open" + "<a " * 350_000)) == "open"
    assert main_text(parse("<div>" * 100_000 + "deep" + "</span></b></section>" * 100_000)) == "deep"
    assert main_text(parse('<p>one<p title="' + "x" * 1_000_000)) == "one"
    assert main_text(parse("<script>" + "<" * 1_000_000)) == ""
    assert main_text(parse("<p>end" + "<!" * 500_000)) == "end"
    assert len(main_text(parse("<" * 200_000))) == 200_000
    assert len(list(nodes(parse("<div class=a>" * 20_000)))) == 20_000
    assert time.process_time() - begun < 30


def plain_importance(pages):
    """path: the larger of the two entropies of its layouts and texts, as shares of the most possible; by recursion over one host."""
    import math
    from collections import Counter, defaultdict

    layouts, texts = defaultdict(Counter), defaultdict(Counter)

    def words_below(e):
        return " ".join(b if isinstance(b, str) else words_below(b) for b in e.blocks if isinstance(b, str) or not b.apart)

    def walk(e, path, seen):
        for b in e.blocks:
            if not isinstance(b, str) and not b.apart:
                own = f"{path}/{b.label}"
                kinds = " ".join(dict.fromkeys(c.label for c in b.blocks if not isinstance(c, str) and not c.apart))
                seen.setdefault(own, []).append((kinds, " ".join(words_below(b).split())))
                walk(b, own, seen)

    for page in pages:
        seen = {}
        walk(parse(page), "", seen)
        for path, found in seen.items():
            layouts[path][" | ".join(dict.fromkeys(k for k, _ in found))] += 1
            texts[path][" ".join(t for _, t in found if t)] += 1

    def share(counts):
        n = sum(counts.values())
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)

    return {p: (sum(layouts[p].values()), share(layouts[p]), share(texts[p])) for p in layouts}


def test_importance_is_that_of_a_plain_count(spark):
    from cinequarry.llm.html_extraction import style_tree

    pages = [f"<body><div class=top>Same</div><div class=tags><i>t{i % 2}</i></div><ul>{'<li>x' * (i % 3)}</ul><div class=text><p>own {i}</p><p>b</p>{'<table></table>' if i % 4 else ''}</div></body>" for i in range(9)]
    frame = spark.createDataFrame([(i, "http://one.example.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r["path"]: (r["pages"], r["layout_importance"], r["content_importance"]) for r in style_tree(frame).collect()}
    expected = plain_importance(pages)
    assert got.keys() == expected.keys()
    for path, values in expected.items():
        assert got[path] == pytest.approx(values, abs=1e-9), path


@pytest.mark.parametrize(
    ("piece", "kept"),
    [
        ('<div class="google-ad">Buy</div>', ""),
        ('<div class="ad_300x250">Buy</div>', ""),
        ('<div class="cookie-law-notice">We use</div>', ""),
        ('<ol class="replies"><li>hi</li></ol>', ""),
        ('<div class="responses"><div class="c">hi</div><div class="c">ho</div></div>', ""),
        ('<section class="discussion"><div>a</div><div>b</div></section>', ""),
        ('<div class="crumbs">a &gt; b</div>', ""),
        ('<div style="color:red; Display : none">x</div>', ""),
        ('<ul class="toc"><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>', ""),
        ('<div class="social"><a>fb</a> <a>tw</a></div>', ""),
        ('<p>The <span class="notice">important</span> thing</p>', "The important thing"),
        ('<div class="social"><p>Social policy is</p></div>', "Social policy is"),
        ('<div class="share-price">up</div>', "up"),
        ('<div class="discussion"><p>We discuss</p><p>more</p></div><p>end</p>', "We discuss more end"),
        ('<div class="discussion"><section class="s"><p>a</p></section><section class="s"><p>b</p></section></div><p>end</p>', "a b end"),
        ('<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>', "one two three"),
        ('<p>Visit <a href="x">the site</a> now</p>', "Visit the site now"),
    ],
)
def test_names_and_what_stands_below_them(piece, kept):
    page = f"<body><article><p>Start.</p>{piece}</article></body>"
    assert main_text(parse(page)) == f"Start. {kept}".strip()


def test_a_small_site_in_plain_words(spark):
    """Pages of two hosts built from known articles: the texts, and nothing else."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        blocks = [line(r.randint(3, 12)) for _ in range(r.randint(1, 6))]
        around = [f'<div class="{c}">{line(4)}</div>' for c in r.sample(["ad-12", "dfp-ad-slot", "newsletter_box", "cookie-bar", "related-posts"], 2)]
        body = around[0].join(f"<p>{b}</p>" for b in blocks)
        html = f"<html><body><nav>{line(5)}</nav><header>{line(3)}</header><article>{body}{around[1]}<ol class='replies'><li>{line(3)}</li></ol></article><footer>{line(2)}</footer></body></html>"
        rows.append((i, f"http://host{i % 2}.net/{i}", html))
        want[i] = " ".join(blocks)
    got = {x["page_id"]: x["text"] for x in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
