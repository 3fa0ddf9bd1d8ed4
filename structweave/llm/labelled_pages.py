"""Small pages with their labels, to train the extraction of main text.

``data-label`` says whether an element and all in it up to the next label is main text (1) or not (0); the body starts
at 0. Bracketed numbers stand for prose of so many sentences, so that texts of many lengths occur.
"""

from __future__ import annotations

import random
import re

_PROSE = (
    "The river rose slowly through the night and by morning the lower fields were under water.",
    "Nobody in the village could remember a spring like it, although the older people had heard of one.",
    "Boats were brought down from the lake, and the school opened its doors to those who had to leave.",
    "Prices went up in the second week.",
    "By then the road to the north had been cleared, and the first lorries arrived with flour and fuel.",
    "A committee was formed, which met every evening in the hall and wrote down what was needed most.",
    "It rained again on Sunday, but less than had been feared.",
)

_PAGES = (
    """<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav>
    <div class="ad">Great shoes at half the price. Only today.</div>
    <article data-label="1"><h1>Floods in the valley</h1><p>[3]</p><p>[1]</p><p>[5]</p><p>Short one.</p></article>
    <footer>&copy; Example News. All rights reserved.</footer></body></html>""",
    """<html><body><header><a href="/">The Gazette</a><p>Your daily paper since 1901.</p></header><main data-label="1"><h1>Water and flour</h1><p>[2]</p><h2>Later</h2>
    <p>[4]</p><blockquote><p>[1]</p></blockquote><ul><li>Bread and milk for two days</li><li>[1]</li></ul>
    <div data-label="0" class="share-buttons"><a href="#">Share</a> <a href="#">Tweet</a></div><p>[2]</p>
    <aside data-label="0" class="related"><h3>Related stories</h3><ul><li><a href="/1">A dry summer ahead, say farmers</a></li><li><a href="/2">The lake in pictures</a></li></ul></aside></main>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>[2]</p></div><div class="comment"><p>Thank you for this, it was a good read.</p></div>
    <form><label>Your name</label><input name="n"><textarea></textarea><button>Send</button></form></section><footer><p>Imprint and privacy. [1]</p></footer></body></html>""",
    """<html><body><div id="top" class="menu"><a href="/">Start</a> | <a href="/about">About</a> | <a href="/x">Archive</a></div>
    <div id="content" class="post" data-label="1"><h1>Notes on a spring</h1><div class="entry"><p>[6]</p><p>[2]</p><p>Not much.</p><pre>line one
    line two</pre></div></div><div id="sidebar"><h3>About me</h3><p>[1]</p><ul><li><a href="/p1">First post</a></li><li><a href="/p2">Second post</a></li></ul></div>
    <div id="footer">Powered by an engine. <a href="/feed">Feed</a></div></body></html>""",
    """<html><body><div class="cookie-notice"><p>We use cookies to make this site better. By going on you agree to our policy.</p><button>Accept</button></div>
    <div class="wrapper"><div class="main" data-label="1"><h2>The committee</h2><p>[1]</p><p>[3]</p><div class="advert" data-label="0"><p>Buy now and save. [1]</p></div><p>[2]</p><table><tr><td>Flour</td><td>12 bags</td></tr>
    <tr><td>Fuel</td><td>[1]</td></tr></table></div><div class="sidebar"><div class="widget"><h4>Popular</h4><ol><li><a href="/1">[1]</a></li><li><a href="/2">Boats on the lake</a></li></ol></div>
    <div class="newsletter"><p>Sign up for our letter.</p><form><input name="mail"><button>Go</button></form></div></div></div><div class="footer"><a href="/t">Terms</a> <a href="/p">Privacy</a></div></body></html>""",
    """<html><body><div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><section><article data-label="1"><header><h1>Rain again</h1></header><p>[1]</p>
    <figure><figcaption>The bridge on Sunday.</figcaption></figure><p>[4]</p><h3>What is next</h3><p>[2]</p></article></section>
    <aside><p>[2]</p><p><a href="/s">Subscribe</a></p></aside><div class="comments"><h3>Readers say</h3><p>[3]</p><p>[1]</p></div><footer><p>[1]</p></footer></body></html>""",
    """<html><body><p data-label="1">[2]</p><p data-label="1">[4]</p><p data-label="1">[1]</p></body></html>""",
    """<html><body><div><div><h1 data-label="1">A plain page</h1><div data-label="1">[5]</div><div data-label="1">[2]</div></div></div><div><a href="/1">One</a> <a href="/2">Two</a></div></body></html>""",
    """<html><body><nav class="navbar"><a href="/">Home</a></nav><div class="alert notice"><p>[1]</p></div><div role="main" data-label="1"><h1>Manual</h1><p>[1]</p><dl><dt>Boat</dt><dd>[1]</dd><dt>Road</dt><dd>[2]</dd></dl>
    <pre><code>run --fast</code></pre><p>[1]</p></div><div class="promo"><p>[1]</p></div><div class="footer-links"><ul><li><a href="/1">Jobs</a></li><li><a href="/2">Press</a></li></ul></div></body></html>""",
    """<html><body><div class="header"><h1><a href="/">Daily Post</a></h1><p>News, views and more</p></div><div class="nav"><ul><li><a href="/w">World</a></li><li><a href="/m">Money</a></li></ul></div>
    <div class="story" data-label="1"><h2>Lorries arrive</h2><p><b>[1]</b></p><p>[3]</p><p>[6]</p><div class="inline-ad sponsored" data-label="0">[1]</div><p>No.</p></div>
    <div id="disqus_thread" class="comment-list"><div><p>[1]</p></div><div><p>[4]</p></div></div><div class="popup"><p>Do not miss out. [1]</p></div></body></html>""",
    """<html><body><header class="site-header"><nav><a href="/1">A</a><a href="/2">B</a></nav></header><form class="search"><p>Search the site</p><input><button>Find</button></form>
    <article class="article-body" data-label="1"><h1>On prices</h1><p>[1]</p><p>[2]</p><ul><li>[1]</li><li>Eggs</li><li>Oil</li></ul><p>[1]</p></article>
    <aside class="ads"><p>[1]</p></aside><footer><ul><li><a href="/i">Imprint</a></li></ul><p>[2]</p></footer></body></html>""",
    """<html><body><nav><ul><li><a href="/a">More</a></li><li>Map</li></ul></nav><div class="ad">[2]</div><article data-label="1"><h1>Ok</h1><p>yes</p></article><footer>[1]</footer></body></html>""",
    """<html><body><nav><a href="/a">More</a> [1]</nav><div class="ad">Cheap.</div><article data-label="1"><h1>A LIST WITHOUT STOPS</h1><p>FIRST!! SECOND!! THIRD</p><p>a 1 b 2 c 3</p></article><footer>[3]</footer></body></html>""",
    """<html><body><div class="banner"><p>[3]</p></div><main data-label="1"><h1><a href="/self">Linked title of the story</a></h1><p><a href="/long">[1]</a></p><p>See also</p></main><footer><p>[4]</p></footer></body></html>""",
    """<html><body><nav><ul><li><a href="/1">[1]</a></li></ul></nav><article data-label="1"><h2>Part</h2><div><p>[1]</p><div><p>Tiny</p></div></div><section><h3>More of it here</h3><p>no stop at its end</p></section>
    <nav data-label="0"><a href="#1">Top</a></nav><form data-label="0"><p>[1]</p></form><footer data-label="0"><p>[1]</p></footer></article><section class="comments"><article><p>[2]</p></article></section></body></html>""",
    """<html><body><header><h1>Site name</h1><p>[1]</p></header><article data-label="1">[3]</article><div class="sponsored">[3]</div><aside>[2]</aside></body></html>""",
    """<html><body><article data-label="1"><h1>One</h1><p>[2]</p></article><article data-label="1"><h1>Two</h1><p>x</p><p>[1]</p></article><div class="side"><h2>[1]</h2><p>[2]</p></div></body></html>""",
    """<html><body><header><p>[1]</p><nav><a href="/">Home</a></nav></header><main data-label="1"><article><h1>A story</h1><p>[2]</p><p>Well.</p><ul><li>First of them</li><li>[1]</li></ul></article>
    <aside data-label="0"><h3>More</h3><p>[1]</p></aside></main><form><label>Mail</label><button>Go</button></form></body></html>""",
    """<html><body><div class="topbar menu"><a href="/">Home</a></div><div id="content" data-label="1"><article class="post"><header><h1>Title of it</h1><p data-label="0" class="share">Share this</p></header><section><p>[1]</p><p>[3]</p></section>
    <section><h2>Next</h2><p>So be it</p></section></article></div><div id="secondary" class="widget-area sidebar"><section><h2>Archive</h2><p>[1]</p></section></div></body></html>""",
    """<html><body><div id="page"><div id="main" data-label="1"><div><div><h1>Deep down</h1><div><p>[2]</p></div></div><div><p>[1]</p><p>Yes</p></div></div></div><div id="comments"><article><p>[1]</p></article><article><p>[2]</p></article></div></div></body></html>""",
)


def labelled_pages() -> list[str]:
    out = []
    for shift, page in enumerate(_PAGES):
        count = iter(range(shift, 10_000))
        out.append(re.sub(r"\[(\d)\]", lambda m: " ".join(_PROSE[next(count) % len(_PROSE)] for _ in range(int(m[1]))), page))
    return out


#: Parts of generated pages; a number in brackets stands for so many sentences, {links} for a list of links.
_TOPS = (
    '<header><a href="/">The Herald</a><nav>{links}</nav></header>', "<nav>{links}</nav>", '<div class="menu">{links}</div>', '<div id="top-nav"><a href="/">Home</a> <a href="/n">News</a></div>',
    '<header><h1>Our paper</h1><p>[1]</p></header>', '<div class="site-header"><p>News since 1901.</p></div>', "",
)
_NOTICES = ('<div class="cookie-consent"><p>[1]</p><button>Accept</button></div>', '<div id="gdpr-banner">We use cookies. <a href="/c">More</a></div>', '<div class="notice">[1]</div>', "", "", "")
#: Where the main text stands. {main} stands for its parts.
_MAINS = (
    '<article data-label="1">{main}</article>', '<article data-label="1">{main}</article>', '<main data-label="1">{main}</main>', '<main data-label="1"><article>{main}</article></main>',
    '<div class="content" data-label="1">{main}</div>', '<div id="story" data-label="1">{main}</div>', '<div class="post-body" data-label="1">{main}</div>', '<div data-label="1">{main}</div>',
    '<div class="wrapper"><div class="entry" data-label="1">{main}</div></div>', '<section><article class="post" data-label="1"><div class="text">{main}</div></article></section>',
)
_PARTS = (
    "<p>[2]</p>", "<p>[1]</p>", "<p>[4]</p>", "<p>So it was.</p>", "<h2>What came next</h2><p>[3]</p>", "<ul><li>[1]</li><li>Bread and milk</li></ul>", "{links}", "<p>[2]</p>{links}<p>[1]</p>",
    "<h3>Sources</h3>{links}", "<p>See also</p>{links}", "<blockquote><p>[1]</p></blockquote>", "<table><tr><td>Flour</td><td>[1]</td></tr></table>", '<p><a href="/s">[1]</a></p>',
    '<div class="warning"><p>[1]</p></div>', '<div class="text-header"><p>[1]</p></div>', '<div class="article-header"><h2>A part</h2><p>[1]</p></div>', "[2]", "<div>[2]</div>", "<pre>run it\nagain</pre>",
    '<p class="lead-text">[1]</p>', "<figure><img src='x'><figcaption>The bridge.</figcaption></figure>", "<ol><li><a href='/1'>First part</a> of it</li><li>[1]</li></ol>",
)
_INSERTS = (
    '<div data-label="0" class="ad">[1]</div>', '<aside data-label="0" class="related"><h3>Related</h3>{links}</aside>', '<div data-label="0" class="share">Share this <a href="#">now</a></div>',
    '<form data-label="0"><p>[1]</p><button>Send</button></form>', '<div data-label="0" class="newsletter-signup"><p>[1]</p></div>', '<nav data-label="0">{links}</nav>', '<div data-label="0" class="promo-box"><p>[2]</p></div>',
    '<aside data-label="0"><p>[2]</p></aside>', '<footer data-label="0"><p>[1]</p></footer>', "", "", "", "",
)
_SIDES = ('<aside><h3>More</h3>{links}<p>[1]</p></aside>', '<div class="sidebar"><h4>Popular</h4>{links}</div>', '<div id="widget-2"><p>[2]</p></div>', '<div class="advert">[2]</div>', "", "")
_COMMENTS = (
    '<section class="comments"><h2>Comments</h2><p>[1]</p><div><p>[2]</p></div></section>', '<div id="comments"><ul><li>[1]</li><li>Thanks.</li></ul></div>', '<div class="comment-list"><article><p>[2]</p></article></div>', "", "", "",
)
_ENDS = ("<footer>&copy; The Herald. [1]</footer>", '<footer>{links}<p>[2]</p></footer>', '<div class="footer"><a href="/t">Terms</a> [1]</div>', '<div id="footer-links">{links}</div>', "")
_TITLES = ("<h1>Water in the valley</h1>", "<h1>Ok</h1>", '<h1><a href="/self">A linked title</a></h1>', "<header><h1>The title</h1><p>[1]</p></header>", "")


def generated_pages(count: int = 200, seed: int = 7) -> list[str]:
    """``count`` labelled pages put together from parts by a seeded generator; about one in eight has text outside any element
    that could be the main one: in the body between other things, or nothing but text."""
    r = random.Random(seed)

    def filled(page: str) -> str:
        page = re.sub(r"\{links\}", lambda _: "<ul>" + "".join(f"<li><a href='/{k}'>{r.choice(_PROSE).rsplit(' ', r.randrange(3, 12))[0]}</a></li>" for k in range(r.randrange(2, 7))) + "</ul>", page)
        return re.sub(r"\[(\d)\]", lambda m: " ".join(r.choice(_PROSE) for _ in range(int(m[1]))), page)

    def part() -> str:
        return r.choice(_PARTS) + r.choice(_INSERTS)

    out = []
    for _ in range(count):
        kind = r.randrange(16)
        if kind == 0:
            page = '<html data-label="1">' + r.choice(("[1]", "[3]", "[2]\n\n[2]"))
        elif kind == 1:
            page = '<html><body data-label="1">' + r.choice(("", '<nav data-label="0">{links}</nav>', '<div class="ad" data-label="0">[1]</div>')) + "[2]" + "".join(r.choice(_PARTS[:6]) for _ in range(r.randrange(4)))
            page += r.choice(("", '<footer data-label="0">[1]</footer>')) + "</body></html>"
        else:
            main = r.choice(_TITLES) + "".join(part() for _ in range(r.choice((1, 2, 3, 5, 8))))
            body = r.choice(_TOPS) + r.choice(_NOTICES) + r.choice(_SIDES) * (r.random() < 0.3) + r.choice(_MAINS).replace("{main}", main)
            page = f"<html><head><title>No</title></head><body>{body}{r.choice(_SIDES)}{r.choice(_COMMENTS)}{r.choice(_ENDS)}</body></html>"
        out.append(filled(page))
    return out
