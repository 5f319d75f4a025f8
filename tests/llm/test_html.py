"""The block labeller on layouts written by hand, apart from the generator of its training pages."""

import random
import re
import resource

from sourcesweep.llm import html

#: +n stands for n words of the article, -n for n words of something else.
LAYOUTS = {
    "plain body": "<body><p>+40</p><p>+60</p></body>",
    "one paragraph": "<body><p>+30</p></body>",
    "title and body": "<html><body><h1>+5</h1><p>+50</p><p>+20</p><p>+70</p></body></html>",
    "wiki": "<body class='skin-vector'><div id='mw-navigation'><ul><li><a href='/'>-1</a></li><li><a href='/r'>-2</a></li></ul></div><div id='content' class='mw-body'><h1>+3</h1><div id='bodyContent'><p>+60 <a href='/x'>word</a> +20</p><ul><li>+8</li><li>+12</li></ul><p>+40</p></div></div><div id='footer'><p>-9</p></div></body>",
    "camel case": "<body><div id='topNav'><a href='#'>-1</a> <a href='#'>-1</a></div><div class='articleBody'><p>+30</p><p>+50</p></div><div class='siteFooter'>-8</div></body>",
    "hashed names": "<body><header><a href='/'>-2</a></header><div class='css-1dbjc4n r-13awgt0'><div class='sc-bdVaJa'><h1>+7</h1><p class='sc-bwzfXH'>+45</p><p class='sc-bwzfXH'>+62</p><p class='sc-bwzfXH'>+30</p></div></div><footer>-6</footer></body>",
    "no names at all": "<body><div><div><h1>+6</h1><p>+30</p><p>+44</p></div></div></body>",
    "aside between": "<body><article><p>+40</p><aside class='pullout'><p>-10</p></aside><p>+50</p><p>+20</p></article></body>",
    "list, table and aside before the end": "<body><article><h1>+4</h1><p>+30</p><ul><li>+5</li><li>+6</li></ul><table><tr><td>+1</td><td>+2</td></tr></table><aside>-9</aside><p>+35</p></article><footer>-7</footer></body>",
    "advert between": "<body><nav><ul><li><a href=/a>-1</a><li><a href=/b>-1</a></ul></nav><div class='post'><p>+40</p><div class='ad-banner'>-5</div><p>+50</p><div class='ad-banner'>-5</div><p>+30</p></div></body>",
    "newsletter between": "<body><main><p>+40</p><form class='newsletter'><p>-12</p><button>-1</button></form><p>+44</p></main></body>",
    "table layout": "<body><table width=100%><tr><td class='leftmenu'><a href=a>-1</a><br><a href=b>-2</a></td><td><p>+60</p><p>+40</p></td></tr></table></body>",
    "blog with sidebar": "<body><div id='wrap'><div id='masthead'><h2>-3</h2></div><div class='entry'><h2>+5</h2><p>+50</p><blockquote><p>+20</p></blockquote><p>+30</p></div><div id='sidebar'><h3>-2</h3><ul><li><a href=x>-4</a></li><li><a href=y>-3</a></li></ul></div></div></body>",
    "comments": "<body><article><h1>+4</h1><p>+70</p></article><section id='comments'><h3>-1</h3><div class='comment'><b>-1</b><p>-25</p></div><div class='comment'><b>-1</b><p>-40</p></div></section></body>",
    "comments inside": "<body><article><p>+45</p><p>+55</p><div class='comments-area'><ol class='commentlist'><li><p>-20</p></li><li><p>-30</p></li></ol></div></article></body>",
    "cookie notice first": "<body><div class='cookie-banner'><p>-20</p><button>-1</button></div><div id='main'><h1>+3</h1><p>+60</p><p>+25</p></div></body>",
    "breaks, no paragraphs": "<body><div class='content'>+40<br><br>+50<br><br>+30</div><div class='footer'>-5</div></body>",
    "definitions": "<body><main><h1>+2</h1><dl><dt>+1</dt><dd>+15</dd><dt>+2</dt><dd>+20</dd></dl><p>+20</p></main></body>",
    "code": "<body><header><nav><a href=/>-1</a></nav></header><main><h1>+4</h1><p>+30</p><pre><code>+12</code></pre><p>+20</p></main></body>",
    "sections": "<body><article><section><h2>+3</h2><p>+30</p></section><section><h2>+2</h2><p>+40</p><ol><li>+9</li><li>+8</li></ol></section></article><footer><p>-10</p></footer></body>",
    "figure": "<body><article><h1>+5</h1><figure><img src=a.png><figcaption>+8</figcaption></figure><p>+80</p></article></body>",
    "related below": "<body><article><p>+50</p><p>+40</p></article><div class='related-posts'><h3>-2</h3><ul><li><a href=1>-6</a></li><li><a href=2>-7</a></li></ul></div></body>",
    "share bar": "<body><div class='story-body'><div class='social-share'><a href=#>-1</a><a href=#>-1</a></div><p>+40</p><p>+60</p></div></body>",
    "breadcrumb": "<body><ol class='breadcrumb'><li><a href=/>-1</a></li><li><a href=/b>-1</a></li></ol><div class='page-content'><h1>+4</h1><p>+70</p></div></body>",
    "unclosed paragraphs": "<body><div id=nav><a href=a>-1</a> <a href=b>-1</a></div><div id=text><p>+30<p>+40<p>+20</div><div id=footer>-7</div></body>",
    "role names": "<body><div role='navigation'><a href=1>-1</a> <a href=2>-1</a></div><div role='main'><p>+50</p><p>+30</p></div><div role='contentinfo' class='footer'>-9</div></body>",
    "item property": "<body><div class='hd header'>-3</div><div itemprop='articleBody'><p>+30</p><p>+42</p></div></body>",
    "deep boxes": "<body><div><div class='row'><div class='col'><div><section><div><p>+30</p><p>+60</p></div></section></div></div></div></div><footer>-5</footer></body>",
    "paragraphs as boxes": "<body><div class='article'><div>+40</div><div>+30</div><div>+55</div></div><div class='sidebar'><div>-5</div></div></body>",
    "short lines": "<body><nav><a href=x>-1</a></nav><article><h1>+3</h1><p>+6</p><p>+7</p><p>+5</p><p>+6</p></article><footer>-8</footer></body>",
    "body class of a template": "<body class='sidebar-left has-footer nav-open'><div class='hentry'><p>+50</p><p>+44</p></div></body>",
    "login form above": "<body><form class='login'><label>-1</label><input><label>-1</label><input><button>-1</button></form><article><p>+60</p><p>+33</p></article></body>",
}


def filled(layout, r):
    """The page, and its texts by sign."""
    said = {"+": [], "-": []}

    def words(m):
        said[m[1]].append(" ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(int(m[2]))).capitalize() + ("." if int(m[2]) > 7 else ""))
        return said[m[1]][-1]

    return re.sub(r"(?<=[> ])([+-])(\d+)", words, layout), said


def test_layouts_written_by_hand(spark):
    r = random.Random(4)
    made = [(f"{name} {k}", *filled(layout, r)) for name, layout in LAYOUTS.items() for k in range(5)]
    found = {x["id"]: x["text"] for x in html.main_text(spark.createDataFrame([m[:2] for m in made], "id string, html string")).collect()}
    main = [(name, text, text in found[name]) for name, _, said in made for text in said["+"]]
    other = [(name, text, text in found[name]) for name, _, said in made for text in said["-"] if len(text) > 12]
    assert len(LAYOUTS) >= 30
    assert sum(x[2] for x in main) >= 0.95 * len(main), [x[0] for x in main if not x[2]]
    assert sum(x[2] for x in other) <= 0.05 * len(other), [x[0] for x in other if x[2]]
    assert not [name for name, _, _ in made if not found[name]]  # no article is lost


def test_reading_is_linear_in_open_elements_and_stray_ends():
    page = "<body><p>first</p>" + "<b>y" * 100_000 + "</i></u>" * 50_000 + "<p>z" * 1000 + "</div>" * 50_000 + "<p>last</p>"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    blocks = html.leaves(page)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB
    assert len(blocks) == 1003 and blocks[0].text == "first" and blocks[-1].text == "last" and blocks[1].depth > 90_000
    assert html.vectors(blocks).shape == (1003, html.INPUTS)
