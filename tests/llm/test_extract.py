import html
import re

from servops.llm import extract
from . import common

LONG = "The house that we saw was on the hill and it had a garden with all of the flowers that you can think of in it."


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>Not this</title><style>p {{margin:0}}</style></head><body>
    <header>Site <a href=x>Home</a></header><nav><ul><li><a href=a>A</a></li></ul></nav>
    <div class="side-bar sidebar"><p>{LONG}</p></div><div class="ad">{LONG}</div><!-- <p>{LONG}</p> -->
    <article><header><h1>Head &amp; line</h1></header><p>{LONG} &lt;b&gt;&nbsp;\n x<b>y</b>z</p><p>Short.<p>No&#228;l<br>two
    <form><p>Sign up for it</p><input name=q></form><script>var t = "<p>{LONG}</p>";</script>
    <ul><li><a href=q>Only a link here</a></li><li>An item</li></ul>
    <section id="comments"><h2>Comments</h2><p>{LONG}</p></section></article>
    <div class="cookie-notice"><p>{LONG}</p></div><aside>{LONG}</aside><footer>&copy; {LONG}</footer></body></html>"""
    assert extract.main_blocks(page) == ["Head & line", LONG + " <b> xyz", "Short.", "Noäl two", "An item"]


def test_unmarked_page_by_two_passes():
    page = f"""<body><div><a href=1>Home</a> | <a href=2>About us</a></div><h1>Title of it</h1><p>{LONG}</p><p>Short one.</p>
    <div><p>{LONG}</p></div><div><a href=3>More</a> <a href=4>Less</a></div><p>Tiny</p><p>Copyright © 2024 by us</p></body>"""
    got = extract.main_blocks(page)
    assert got[:4] == ["Title of it", LONG, "Short one.", LONG] and "Copyright © 2024 by us" not in got
    assert not any("Home" in b or "More" in b for b in got)


def test_only_an_elements_own_names_count():
    keep = f'<div title="the hidden comment" data-hidden="x" data-id="sidebar"><p>{LONG}</p></div>'
    assert extract.main_blocks(keep) == [LONG]
    for names in ('class="x ad-slot"', "id=sidebar", "hidden", 'aria-hidden="true"', 'style="display: none"', 'role="navigation"',
                  'class="legal"'):
        assert extract.main_blocks(f"<div {names}><p>{LONG}</p></div><p>{LONG} x</p>") == [LONG + " x"], names


def test_labels():
    assert extract.second_pass(["?", "good", "?", "?", "bad", "?"], False) == [True, True, True, False, False, False]
    assert extract.second_pass(["good", "?", "bad"], False) == [True, True, False]
    assert extract.second_pass(["?", "?"], True) == [True, True] and extract.second_pass([], True) == []


def test_broken_markup_ends():
    for page in (None, "", "<", "<p", "a < b", "<!--", "<script>", "</", "<a href='x", "<p>" * 5000, "<div class=ad>", "&#xZZ; &amp",
                 "<article>" + "<" * 2000, "<title>x"):
        assert isinstance(extract.main_blocks(page), list)
    assert extract.main_blocks(f"<body><div class=ad>x<article><p>{LONG}</p></article>") == [LONG]
    assert extract.main_blocks(f"<article><p>{LONG}") == [LONG]


def test_operator(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", f"<article><p>{LONG}</p></article>"),
            (3, "w", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([r + ("x", "x", "x") for r in rows], "page_id long, url string, html string, text string, row string, main string")
    got = extract.extract_main_text(df)
    assert got.columns == ["page_id", "url", "row", "main", "text", "n_chars", "n_blocks"]
    by = sorted((str(r["page_id"]), r["text"], r["n_chars"], r["n_blocks"]) for r in got.collect())
    assert by == sorted([("1", LONG, len(LONG), 1)] * 2 + [("2", "", 0, 0), ("None", "", 0, 0),
                                                          ("3", "\n".join([LONG] * 3000), 3000 * len(LONG) + 2999, 3000)])
    assert extract.extract_main_text(df.limit(0)).count() == 0


def test_pages_of_the_data(spark):
    """Against the plain reading of these pages' markup."""
    from servops.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op3_main_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)[^>]*>", article)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_stop_words_are_there():
    assert all(len(w.split()) >= 20 for w in extract.STOP_WORDS.values()) and common.SCHEMA


def test_unmarked_pages_in_languages_without_stop_words():
    for text in ("Wczoraj wieczorem cała rodzina poszła do teatru, żeby zobaczyć nową sztukę, którą napisał młody autor z Krakowa.",
                 "Сегодня утром жители города увидели первый снег, который выпал ночью и покрыл все улицы, дома и деревья белым ковром.",
                 "今天早上城市的居民看到了第一场雪，昨天晚上的雪覆盖了所有的街道、房屋和树木，孩子们非常高兴地跑到外面去玩雪，老人们坐在窗边喝着热茶，看着外面的白色世界，大家都觉得这是一个美好的早晨。"):
        page = f"<body><div><a href=1>{text}</a></div><p>{text}</p><p>{text} 2</p><p>Copyright © 2024 {text}</p></body>"
        assert extract.main_blocks(page) == [text, text + " 2"]


def test_wrappers_with_hints_do_not_lose_the_article():
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG} 2</p>"
    for names in ('class="site has-sidebar"', 'class="wrap with-header"', 'class="layout sidebar-right"', 'id="page" class="no-comments"',
                  'class="comments-open"', 'class="ads widget-area"'):
        for inner in (body, f"<main>{body}</main>", f"<article>{body}</article>"):
            page = f"<body><nav><a href=x>Home</a></nav><div {names}><div>{inner}</div></div><footer>{LONG}</footer></body>"
            if "comments-open" not in names or "<article>" not in inner:
                assert extract.main_blocks(page) == ["Head", LONG, LONG + " 2"], (names, inner)


def test_ids_made_from_headings_stay():
    page = "<article><p>{0}</p>" + "".join(f'<section id="{k}"><h2>{k}</h2><p>{{0}}</p></section>' for k in (
        "search-algorithms", "related-work", "comments", "related-posts", "newsletter-box")) + "</article>"
    assert extract.main_blocks(page.format(LONG)) == [LONG, "search-algorithms", LONG, "related-work", LONG]


def test_both_passes_in_a_marked_article():
    page = f"""<article><h1>Share prices fell</h1><p>{LONG}</p><p>Share this on social media</p><p>{LONG} 2</p><p>A short end.</p>
    <p>Subscribe now for more</p><ul><li><a href=1>One page of many</a></li><li>or</li><li><a href=2>Another page</a></li></ul></article>"""
    assert extract.main_blocks(page) == ["Share prices fell", LONG, LONG + " 2", "A short end."]
    assert extract.second_pass(["?", "bad", "?", "bad", "?"], False, True) == [True, False, False, False, True]


def test_comments_that_are_articles():
    thread = "".join(f'<article class="entry"><p>{LONG} {k}</p></article>' for k in range(9))
    for page in (f'<div class="post"><p>{LONG}</p></div><div id="comments">{thread}</div>',
                 f'<article><p>{LONG}</p><div class="comment-list">{thread}</div></article>',
                 f'<main><p>{LONG}</p></main><section class="comments">{thread}</section>'):
        assert extract.main_blocks(page) == [LONG]
    assert extract.main_blocks(f'<div class="commentaries"><p>{LONG}</p></div>') == [LONG]


def plain_labels(blocks):
    """Both passes on an unmarked page, read plainly."""
    first = [extract.first_pass(b, False, extract.listed(blocks)) for b in blocks]
    out = []
    for i, v in enumerate(first):
        near = sorted((abs(i - k), w != "good") for k, w in enumerate(first) if w != "?")
        out.append(v == "good" if v != "?" else "bad" not in first if not near else not near[0][1])
    return out


def test_two_passes_against_a_plain_version():
    import random
    random.seed(5)
    parts = [LONG, "Short one.", "Tiny", "<a href=x>" + LONG + "</a>", "Copyright © 2024 by us", "zq " * 40, "Follow us on Twitter", "<b>x</b> y"]
    for _ in range(300):
        page = "".join(f"<p>{random.choice(parts)}</p>" for _ in range(random.randint(0, 12)))
        blocks, marked = extract.blocks_of(page)
        assert not marked
        assert extract.main_blocks(page) == [b.text for b, k in zip(blocks, plain_labels(blocks)) if k]
