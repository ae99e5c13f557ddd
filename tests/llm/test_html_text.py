import re
import time
from html import unescape

from tidemark.llm import html_text as H

PRIOR = H.Weights({})
PAGE = """<html><head><title>x</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a> <a>News</a></nav></header>
<div class="cookie-notice">We use cookies to improve your visit, accept them all please.</div>
<div id="content"><h2>Title of it</h2><p>First paragraph &amp; more words here to read, with a <a href="x">link inside</a> it.<div class="ad-slot">Buy now! Cheap things for all of you out there.</div>
<p>Second&nbsp;paragraph   goes on<br>after a break.</p><ul><li>one item</li><li>two item</li></ul></div>
<aside class="sidebar"><p>Related stories that you may like to read after this one.</p></aside><section id="comments"><p>Great article, thanks a lot for that, really.</p></section>
<form><label>Mail</label><input></form><footer>(c) 2024 all rights reserved</footer></body></html>"""


def test_content_without_any_label():
    want = "Title of it\n\nFirst paragraph & more words here to read, with a link inside it.\n\nSecond paragraph goes on after a break.\n\none item\n\ntwo item"
    assert H.content(PAGE, PRIOR) == want


def test_small_pages():
    assert H.content("", PRIOR) == "" and H.content("plain &lt;text&gt; only", PRIOR) == "plain <text> only"
    assert H.content("<p>a<b>c</p><p>d<script>var x='<p>no</p>'</script>", PRIOR) == "ac\n\nd"
    assert H.content("<!-- <p>no</p> --><p>yes <img alt='a > b'> so", PRIOR) == "yes so"


def test_the_scan_finds_the_best_stretch():
    import random

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = H.best_stretch(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_articles_are_recovered_whole(spark, sf):
    """Pages whose article is named, against the named element itself."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    out = H.extracted(pages).collect()
    assert len(out) == len(source)
    for r in out:
        article = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_weights_learned_on_named_articles_carry_over_to_pages_without(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.fit(pages)
    good = 0
    rows = pages.collect()
    for r in rows:
        bare = re.sub(r"</?article>", "", r["html"])
        good += H.content(bare, weights) == H.content(r["html"], weights)
    assert good >= 0.9 * len(rows)


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, ""), (2, "u", "<p>" * 5000 + "x"), (3, "u", "<<<>>>&#0;&bogus;")], "page_id long, url string, html string")
    assert H.extracted(pages).count() == 5 and H.extracted(pages.limit(0)).count() == 0


PARTS = "<p>First paragraph of the article has some words here.</p><p>Second paragraph also has some words to read.</p>"
TEXT = "First paragraph of the article has some words here.\n\nSecond paragraph also has some words to read."


def test_an_ancestors_class_or_form_never_empties_a_page():
    for open_, close in [('<div class="page has-sidebar">', "</div>"), ('<div id="form-page">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div class="sidebar">', "</div>")]:
        for inner in (f"<article><h1>T</h1>{PARTS}</article>", f"<h1>T</h1>{PARTS}"):
            assert H.content(f"{open_}<nav><a href=x>Home</a></nav>{inner}{close}", PRIOR) == f"T\n\n{TEXT}", (open_, inner)


def test_boxes_are_bridged_and_several_articles_kept():
    box = f'<div class="related">{"Some related stories to click on. " * 20}</div>'
    for page in (f"<article>{PARTS}{box}<p>The whole article stands here.</p></article>", f"{PARTS}{box}<p>The whole article stands here.</p>"):
        assert H.content(page, PRIOR) == f"{TEXT}\n\nThe whole article stands here."
    assert H.content(f"<main><p>Intro.</p><article><h2>A</h2>{PARTS}</article><article>{PARTS}</article></main>", PRIOR) == f"Intro.\n\nA\n\n{TEXT}\n\n{TEXT}"
    kept = '<h2 id="social-impact">Impact</h2><p>Text.</p><section id="related-work"><p>Work that others did.</p></section><p>Let <math><mi>x</mi></math> be.</p>'
    assert H.content(f"<article>{kept}</article>", PRIOR) == "Impact\n\nText.\n\nWork that others did.\n\nLet x be."


def test_a_quote_that_never_closes_leaks_no_markup():
    assert H.content('<article><p>so <a href="foo>broken link</p><p>and <b class="x">more</b></p></article>', PRIOR) == "so broken link\n\nand more"
    assert H.content("<p title='a > b' lang=en>one <i>two</i></p>", PRIOR) == "one two"


def test_broken_pages_take_linear_time():
    for part in ("<div>x", '<a href="x ', '<a href="x> ', "<p>x", "<b>x", "</div>x", "<script>", "<!-- ", '<div class="a">x', "<ul><li>x", "<svg>", "<a b='>", "<", "&amp", "<a b=\"'>", '<div class="sidebar"><h1>t</h1>xx ', '<div class="sidebar">x ', f'<p class="{"a " * 50}">x'):
        for n in (100_000, 400_000):  # a quadratic reader takes minutes for the second
            began = time.process_time()
            H.content(part * (n // len(part)), PRIOR)
            assert time.process_time() - began < 8 * n / 400_000 + 1, part


def test_learned_names_decide_where_no_page_names_its_content(spark, sf):
    """Advert and footer under names that no list holds, and no article element: the weights find the article, the pseudo-counts do not."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("html", H.F.expr("replace(replace(replace(html, 'class=\"ad\"', 'class=\"zq7\"'), '<footer>', '<div class=\"k3\">'), '</footer>', '</div>')"))
    weights = H.fit(pages)
    rows = pages.collect()
    learned = plain = 0
    for r in rows:
        want = H.content(r["html"], weights)
        bare = re.sub(r"</?article>", "", r["html"])
        learned += H.content(bare, weights) == want
        plain += H.content(bare, PRIOR) == want
    assert learned >= 0.95 * len(rows) and plain <= 0.1 * len(rows)


def test_every_name_of_an_element_counts():
    many = " ".join(f"c{k}" for k in range(40))
    for names in (f"advert {many}", f"{many} advert"):
        assert H.content(f'<article>{PARTS}<div class="{names}">Buy now.</div></article>', PRIOR) == TEXT


def test_only_what_browsers_show_as_blocks_parts_a_text():
    for inner in ("foo <script>x()</script>bar baz", "foo <svg><path/></svg>bar baz", "foo <my-tag>bar</my-tag> baz", "foo <style>b{}</style><template>no</template>bar <time>baz</time>", "<label>foo</label> <slot>bar</slot> <wbr>baz"):
        assert H.content(f"<article><p>{inner}</p><p>more</p></article>", PRIOR) == "foo bar baz\n\nmore", inner
    assert H.content("<article>a<div>b</div>c<my-box><p>d</my-box>e</article>", PRIOR) == "a\n\nb\n\nc\n\nde"


def test_wrappers_as_one_round_at_a_time():
    """The element that holds most words is unwrapped as the rounds that the definition names would do it."""
    import random

    def by_rounds(page, weights):
        about = page.kept_open()
        if about:
            return H.boxes(page, weights, about)
        below = page.words_below()
        while True:
            box = H.boxes(page, weights, about)
            left = sum(n for node, _, n, _ in page.events if n > 0 and box[node] < 0)
            titled = {box[i] for i in range(len(page.tag)) if page.tag[i] == "h1"}
            found = {b for b in set(box) - {-1} if 2 * below[b] > below[0] and page.tag[b] not in ("nav", "footer") and (b in titled or 10 * left < below[0])}
            if not found:
                return box
            about = about | found

    rng = random.Random(6)
    for _ in range(400):
        html, open_ = "", []
        for _ in range(rng.randrange(1, 40)):
            if open_ and rng.random() < 0.35:
                html += f"</{open_.pop()}>"
            elif rng.random() < 0.5:
                tag, name = rng.choice(["div", "div", "aside", "nav", "footer", "p", "form"]), rng.choice(["sidebar", "x", "ad", "page"])
                open_.append(tag)
                html += f'<{tag} class="{name}">'
            else:
                html += rng.choice(["<h1>t</h1>", "w " * rng.randrange(1, 12), "w ", "v v v v v v v v v v v v "])
        page = H.Page(html)
        assert H.page_boxes(page, PRIOR) == by_rounds(page, PRIOR), html


def test_content_is_the_best_stretch_of_recomputed_scores(spark, sf):
    """Scores of words, tags and boxes of unlabelled pages, added up for every stretch."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = H.fit(pages)
    checked = 0
    for r in pages.limit(40).collect():
        page = H.Page(re.sub(r"</?article>", "", r["html"]))
        box, features, items = H.page_boxes(page, weights), page.word_features(), []
        for (node, block, n, text), feature in zip(page.events, features):
            if box[node] >= 0:
                old = next((i for i in items if i[0] == box[node]), None)
                if old is None:
                    items.append(old := [box[node], 0.0, None, ""])
                old[1] = max(-H.BRIDGE, old[1] - H.MOST * max(0, n))
            else:
                a, b = weights.counts.get(feature if n >= 0 else f"cost:{text}", (0.0, 0.0))
                p, q = H.pseudo(feature if n >= 0 else f"cost:{text}")
                per = max(-H.MOST, min(H.MOST, H.math.log((a + p) / (b + q)))) if n >= 0 else -0.1 - (b + q) / (a + b + p + q)
                items.append([None, per * n if n >= 0 else per, block if n >= 0 else None, text])
        if len(items) > 400:
            continue
        best, at = 1e-12, (0, 0)
        for i in range(len(items)):
            total = 0.0
            for j in range(i, len(items)):
                total += items[j][1]
                if total > best + 1e-9:
                    best, at = total, (i, j + 1)
        blocks = {}
        for _, _, block, text in items[at[0] : at[1]]:
            if block is not None:
                blocks.setdefault(block, []).append(text)
        joined = [" ".join("".join(x).split()) for x in blocks.values()]
        assert H.content(re.sub(r"</?article>", "", r["html"]), weights) == "\n\n".join(x for x in joined if x)
        checked += 1
    assert checked >= 20
