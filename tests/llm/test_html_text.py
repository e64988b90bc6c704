import html
import random
import re

import pytest

from strandloom.llm import html_text as ht

GOOD = "The cat and the dog are in the house of the man with a hat that was on the mat for a day."
RUSSIAN = "Сегодня утром жители города увидели на площади нечто странное, и никто не мог объяснить, что это было. Говорят, что так бывает."
CHINESE = "今天早上，城里的居民在广场上看到了奇怪的东西，没有人能解释那是什么。据说这样的事情以前也发生过。"
FINNISH = "Tänä aamuna kaupungin asukkaat näkivät torilla jotakin outoa, eikä kukaan osannut selittää mitä se oli. Sanotaan että niin käy."


def plain_labels(found):
    """Labels of blocks (text, linked, section, outside, article) by both passes, one block at a time, for pages in a language with known stop words."""
    labels = []
    for text, linked, section, outside, article in found:
        words = [w.strip(".,;:!?\"'()*#$%&|") for w in text.lower().split()]
        if outside or linked > 0.33 * len(text) and not (article and len(text) - linked >= 70):
            labels.append("bad")
        elif len(text) >= 70 and sum(w in ht.STOP_WORDS for w in words) >= 0.15 * len(words):
            labels.append("good")
        else:
            labels.append("open")
    out = []
    for k, label in enumerate(labels):
        if label == "open":
            near = {}
            for j in sorted(range(len(labels)), key=lambda j: abs(j - k)):
                if labels[j] != "open":
                    if found[j][2] == found[k][2] and not found[j][3]:
                        near.setdefault(("own", j < k), (abs(j - k), labels[j]))
                    near.setdefault(("any", j < k), (abs(j - k), labels[j]))
            own, any_ = ([v for (kind, _), v in near.items() if kind == which] for which in ("own", "any"))
            if own:
                label = "good" if any(v[1] == "good" for v in own) else "bad"
            elif found[k][4]:
                label = "good"
            else:
                label = "good" if (min(v[0] for v in any_), "good") in any_ else "bad"
        out.append(label)
    return out


def test_two_passes_against_brute_force():
    rng = random.Random(5)
    texts = [GOOD, GOOD + " " + GOOD, "Short one.", "Tiny", "xq zv wk " * 10, "A line of the day that is not so long"]
    for _ in range(2000):
        found = [(t := rng.choice(texts), rng.choice([0, 0, 0, len(t), len(t) // 2]), rng.randrange(4), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randrange(1, 14))]
        found.append((GOOD * 3, 0, 9, False, False))  # the page has an article, and its language is known
        made = [ht.Block(*f) for f in found]
        ht.decide(made)
        assert [b.label for b in made] == plain_labels(found), found


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("  \n ", ""),
        ("<", ""),
        ("a < b &amp; c", ""),
        ("<article>a < b &amp; c", "a < b & c"),
        ("<p>x", ""),
        ("<p>It is x.", "It is x."),
        ("<title>t</title><p>It says hi. <script>var a = '<p>the'", "It says hi."),
        ("<div>Login</div><div>Home</div>", ""),
        ("<div>Login</div><div>A word to the wise.</div>", "A word to the wise."),
        ("<a href=x>y</a>", ""),
        (f"<article><h1>Title</h1><p>{GOOD}<p>Short.</article>", f"Title\n\n{GOOD}\n\nShort."),
        (f"<article><p>a&nbsp;b\n\t c<br>d <b>e</b>f</p></article>", "a b c d ef"),
        (f"<nav>menu of the day</nav><header><h1>Site</h1></header><main><p>{GOOD}</p></main><aside>The news of the day</aside><footer>{GOOD}</footer>", GOOD),
        (f"<div class='ad'>{GOOD}</div><article><p>{GOOD}</p></article><div id=cookie-notice><p>{GOOD}</p></div>", GOOD),
        (f"<article><p>{GOOD}</p></article><section class='comments'><article><p>{GOOD} I say.</p></article></section>", GOOD),
        (f"<div class='page has-sidebar overflow-hidden'><article class='post share'><div class='post-header'><h1>Title</h1></div><p>{GOOD}</p></article><div class='sidebar-right'><p>{GOOD}</p></div></div>", f"Title\n\n{GOOD}"),
        (f"<form><p>{GOOD}</p></form><div><p>{GOOD}</p></div>", GOOD),
        (f"<article><p>{GOOD}</p><table><tr><td>a | b</td></tr></table></article>", f"{GOOD}\n\na | b"),
        (f"<style>p{{}}</style><!-- <p>no</p> --><article><p>{GOOD}</p><footer>&copy; x", GOOD),
        (f"<article><p>{GOOD}</p><p style='display:none'>x</p><div hidden><p>{GOOD}</p></div></article>", GOOD),
        (f"<div><p>{GOOD}</p><p>Short one.</p><p>{GOOD}</p></div><div><p><a href=1>Links and</a> <a href=2>more of the links</a></p><p>Tiny</p></div>", f"{GOOD}\n\nShort one.\n\n{GOOD}"),
        # names of any element, inside of articles too
        (f"<article><p class='advertisement'>Buy it now</p><p>{GOOD}</p><p class=comment>I like it.</p><h3 class='related-title'>More of this</h3><p>{GOOD} <span class=ad>And buy.</span> So.</p><p style='display: none'>x</p></article>", f"{GOOD}\n\n{GOOD} So."),
        (f"<article><p>{GOOD}</p><ul class='share-buttons'><li>Tell it</li></ul><div class='newsletterBox'><p>{GOOD}</p></div><p>Short.</p></article>", f"{GOOD}\n\nShort."),
        # what they speak of inside of articles stays
        (f"<article><div class='warning'><p>Keep off.</p></div><section class='legal-analysis'><p>{GOOD}</p></section><div class='share-price'>It fell by 3.</div><p class='search-history'>Then.</p></article>", f"Keep off.\n\n{GOOD}\n\nIt fell by 3.\n\nThen."),
        (f"<div class='warning'>Keep off.</div><article><p>{GOOD}</p></article>", GOOD),
        # an unclosed paragraph that isn't the article ends with the next block, an inline element with its block
        (f"<article><p class=ad>Buy it<p>{GOOD}<p>One <i class=promo>two<p>Three.</article>", f"{GOOD}\n\nOne\n\nThree."),
        (f"<article><ul><li class=ad>Buy<li>First.<li>Second.</ul><p>{GOOD}</p></article>", f"First.\n\nSecond.\n\n{GOOD}"),
        # other scripts and languages
        (f"<div><a href=1>Главная</a> <a href=2>Новости</a></div><div><h1>Заголовок</h1><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div><div><a href=3>Контакты и прочее</a></div>", f"Заголовок\n\n{RUSSIAN}\n\n{RUSSIAN}"),
        (f"<ul><li><a href=1>首页</a></li><li><a href=2>新闻</a></li></ul><div><h2>标题</h2><p>{CHINESE}</p><p>好的。</p></div><div class='cookie-bar'><p>{CHINESE}</p></div>", f"标题\n\n{CHINESE}\n\n好的。"),
        (f"<table><tr><td><a href=1>Etusivu</a></td></tr></table><div><p>{FINNISH}</p><p>{FINNISH}</p></div><div>Kirjaudu</div>", f"{FINNISH}\n\n{FINNISH}"),
        # nested menus beside text without an article element, and a list of links in the text
        (f"<div id=menu><div><div><p>{GOOD}</p></div></div></div><div id=content><p>{GOOD}</p><ul><li><a href=1>one of the links</a></li></ul><p>{GOOD}</p></div><div role=contentinfo>{GOOD}</div>", f"{GOOD}\n\n{GOOD}"),
    ],
)
def test_pages(page, text):
    assert ht.main_text(page) == text


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside))
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    found = {r["page_id"]: r for r in ht.extract(pages).collect()}
    assert {k: r["text"] for k, r in found.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())


def test_odd_rows(spark):
    long = "<article>" + f"<p>{GOOD}</p>" * 20_000
    rows = [(1, "u", long, "x"), (1, "u", long, "x"), (None, None, None, None), (2, "u", "", "x")]
    found = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 4 and sorted(r["n_chars"] for r in found) == [0, 0, *[20_000 * (len(GOOD) + 2) - 2] * 2]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
