import random

from docloom.llm import html_text as H

LONG = "This is the first part of a story that goes on and on, and it has all of the words that people use when they write. " * 3


def test_article_without_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header>Site name</header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
    <article><h1>Title &amp; more</h1><p><b>Lead text<br><p>{LONG}</p><p>Short.</p><div class="share-box">Share this</div>
    <form>Name <input></form></article><aside>{LONG}</aside><section id="comments"><article><p>{LONG}</p></article></section>
    <div class="cookie-notice">{LONG}</div><footer>&copy; us</footer></body></html>"""
    assert H.main_text(page) == f"Title & more\n\nLead text\n\n{LONG.strip()}\n\nShort."


def test_rules_without_article():
    links = "".join(f'<li><a href="/{i}">Link number {i} to some place</a></li>' for i in range(9))
    page = f"<div><ul>{links}</ul></div><h2>Head</h2><p>{LONG}</p><p>Near the end.</p><p>{LONG}</p><p>xqz {'zzz ' * 60}</p><div>Tail</div>"
    assert H.main_text(page) == f"Head\n\n{LONG.strip()}\n\nNear the end.\n\n{LONG.strip()}"


def test_an_article_of_odd_words_is_kept():
    assert H.main_text("<main><p>" + "Orre " * 90 + "</p><p>Ene.</p></main>") == ("Orre " * 90).strip() + "\n\nEne."
    assert H.main_text("<article><p>One.</p></article>") == "One."


def test_white_space_and_references():
    assert H.main_text("<article>a\n\t b&nbsp;&#233;&eacute;<b>c</b>d<br>e &lt;p&gt; 1 < 2</article>") == "a b éécd e <p> 1 < 2"
    assert H.main_text("<article><p>one<br><br>two</p></article>") == "one\n\ntwo"


def test_furniture_inside_an_article():
    for odd in (
        '<p class="advert">Buy this now.</p>', "<p hidden>Not seen.</p>", '<ul><li class="comment">Nice one!</li></ul>', '<h2 class="related">More</h2>',
        '<span style="display:none">Not <span>seen</span> at all.</span>', f'<div class="cookie-notice"><p>{LONG}</p></div>', f'<p class="ad">{LONG}',
    ):
        page = f"<article><p>{LONG}</p>{odd}<p>{LONG}</p></article>"
        assert H.main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}", odd
    assert H.main_text(f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>') == LONG.strip()


def test_names_that_only_sound_like_furniture():
    for name in ("has-sidebar content", "post share-enabled", "no-comments", "article with-ads", "heading adage"):
        assert H.main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG.strip(), name
    assert H.main_text(f'<p>{LONG}</p><div class="comments-area"><p>{LONG}</p></div><div class="left sidebar-2"><p>{LONG}</p></div>') == LONG.strip()


def test_other_languages():
    texts = (
        "Questa storia parla della vita di molte persone che lavoravano nella campagna vicino al fiume, dove ogni giorno cominciava prima dell'alba, mentre gli animali dormivano ancora tranquilli sotto gli alberi antichi.",
        "Эта история рассказывает о людях, которые жили у большой реки и каждый день начинали работать до рассвета, пока животные ещё спали под старыми деревьями возле дороги и никто не проходил мимо.",
        "这个故事讲述了住在大河边的人们的生活他们每天在黎明之前就开始工作那时动物们还在路边的老树下安静地睡着没有人经过这里直到太阳升起照亮了整个村庄和田野大家才一起回家吃早饭",
    )
    menu = "".join(f'<li><a href="/{i}">Categoria numero {i} del sito</a></li>' for i in range(8))
    for t in texts:
        assert H.main_text(f"<body><ul>{menu}</ul><h1>T</h1><p>{t}</p><p>{t}</p></body>").split("\n\n")[-2:] == [t, t]


def test_raw_tags_without_an_end_and_links():
    assert H.main_text(f"<article><noscript><p>{LONG}</p>") == LONG.strip()
    link = '<p>See <a href="x">a page with a name that is long, longer than all else that stands in this paragraph</a> now.</p>'
    assert "See a page" in H.main_text(f"<article><p>{LONG}</p>{link}<p>{LONG}</p></article>")


def test_broken_markup():
    for page in (None, "", "<", "<p", "a < b", "<!--", "<script>x", "<p>a</q></p", "<a href='x>y", "</div></div><p>", "<article><p>x</article"):
        H.main_text(page)
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=\"", ">", "<", "&amp", "text ", "<script>", "</script>", "<!--", "-->", "\"", "'", "<article>"]
    for _ in range(3000):
        H.main_text("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))


def test_long_pages_take_little_time():
    for unit in ("<a \">", "<p>x", "<div class='a'>", "<", "&", "<!-- ", "<p 'x>", "<noscript>", "<li>x", "<span hidden>", "<b hidden><i>"):
        H.main_text(unit * 100_000)


def test_frames(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", f"<p>{LONG}</p>" * 300, "t"), (None, "u", "<article>x</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_pages(df).collect()
    assert sorted((r.text[:4], len(r.text)) for r in got)[:2] == [("", 0), ("", 0)]
    assert max(len(r.text) for r in got) == 300 * len(LONG.strip()) + 299 * 2
    assert H.extract_pages(df.limit(0)).count() == 0
