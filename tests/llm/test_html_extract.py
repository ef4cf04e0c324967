import random

import numpy as np

from tablesteps.llm import html_extract as H


def kept(page):
    blocks = H.blocks_of(page)
    has_main = any(p == H.MAIN for p, _ in blocks)
    return " ".join(b for p, b in blocks if p == (H.MAIN if has_main else H.OPEN))


def test_articles():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- ad --><div class=ad>Buy</div>"
        "<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld<br>two&nbsp;\n three<p>four<div class='share-bar'>share</div>"
        "<aside>side</aside><form>name <input></form><section id=comments><p>nice</p></section></article>"
        "<div>teaser</div><footer>&copy; all</footer>"
    )
    assert kept(page) == "Head & line One bold two three four"


def test_markup_without_an_article():
    assert kept("plain &lt;text&gt; only") == "plain <text> only"
    assert kept("<body class='no-sidebar'><p>a<div class=cookie-notice>b</div><span hidden>c</span>d<ul><li>e<li class='advert'>f</ul>") == "a d e"
    assert kept("<main><div class='article-header'>title</div><p>x</p></main><p>out</p>") == "title x"
    assert kept("<p>a<script>b") == "a" and kept("<!-- open <p>x") == "" and kept("< 3 <p>x</p> 1 > 0") == "< 3 x 1 > 0"
    assert kept("<p>&eacute;&#233;&#xE9;&amp;lt;&bogus;") == "ééé&lt;&bogus;"


def brute(streams, long, pages):
    different = {tuple(s) for s in streams}
    out = []
    for s in streams:
        mask = [False] * len(s)
        for i in range(len(s) - long + 1):
            part = tuple(s[i : i + long])
            if sum(any(part == t[j : j + long] for j in range(len(t))) for t in different) >= pages:
                mask[i : i + long] = [True] * long
        out.append(mask)
    return out


def test_repeated_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        base = [rng.randint(1, 4) for _ in range(12)]
        streams = [
            [rng.randint(1, 5) for _ in range(rng.randint(0, 12))] + base[rng.randint(0, 3) :][: rng.randint(0, 12)] for _ in range(8)
        ]
        streams.append(list(streams[0]))
        got = H.repeated([np.array(s, dtype=np.int64) for s in streams], 4, 3)
        assert [m.tolist() for m in got] == brute(streams, 4, 3)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_boilerplate_of_a_host_goes(spark):
    notice = "<div>this host tells every reader the very same thing</div>"
    rows = [(i, f"https://h.example/{i}", f"{notice}<p>all w{i} own words of page {i} and no other {i}</p>{notice}") for i in range(6)]
    rows += [(10, "https://other.example/a", f"{notice}<p>elsewhere</p>"), (11, None, f"{notice}x"), (12, "::odd", None), (13, "", "")]
    rows += [(20 + i, f"https://h.example/{i}", f"<article><p>the same article may stand on many pages</p></article>{notice}") for i in range(3)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows), ["page_id"]).collect()}
    for i in range(6):
        assert out[i] == f"all w{i} own words of page {i} and no other {i}"
    assert out[10] == "this host tells every reader the very same thing elsewhere"
    assert out[12] == out[13] == "" and out[11].endswith("thing x")
    assert {out[20 + i] for i in range(3)} == {"the same article may stand on many pages"}


def test_shards_of_a_large_host(spark):
    rows = [(i, "http://U@H.example:80/x", f"<p>menu of the whole site stands here</p><p>page {i} has {i * 7} own words</p>") for i in range(60)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows), ["page_id"], shard_bytes=1000).collect()}
    assert out == {i: f"page {i} has {i * 7} own words" for i in range(60)}


def test_empty_table_and_odd_columns(spark):
    assert H.extract(pages_of(spark, []), ["page_id"]).collect() == []
    df = spark.createDataFrame([(1, "http://a/b", "<p>x</p>", "h", 2)], "page_id long, url string, html string, host string, `shard` int")
    out = H.extract(df, df.columns)
    assert out.columns == [*df.columns, "text", "n_repeated"] and out.first().text == "x" and out.first().host == "h"


def test_unique_runs_outside_an_article_stay(spark):
    teaser = "<div>read what the others wrote about us here</div>"
    rows = [(i, "http://h/x", f"{teaser}<article><p>story {i}</p></article><p>note n{i} by the editor e{i}</p><nav>go {i}</nav>") for i in range(5)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows), ["page_id"]).collect()}
    assert out == {i: f"story {i} note n{i} by the editor e{i}" for i in range(5)}


def test_shards_do_not_change_the_result(spark):
    notice = "<div>these words stand on many pages of one very large host</div>"
    rows = [(i, "http://big/x", (notice if i % 3 == 0 else "") + f"<p>a{i} b{i} c{i} d{i} e{i} f{i} g{i}</p>") for i in range(40)]
    df = pages_of(spark, rows)
    few, many = ({tuple(r) for r in H.extract(df, ["page_id"], shard_bytes=b).collect()} for b in (1 << 20, 100))
    assert few == many and {r[2] for r in many if r[0] % 3 == 0} == {11} and not any("words" in r[1] for r in many)


def test_shared_prose_stays(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    phrase, passage, saying = words(6), words(15), words(8)
    rows, own = [], {}
    for i in range(30):
        shared = {phrase: i < 5, passage: 5 <= i < 9, saying: i % 2}  # passages of few pages, a saying of half of them
        own[i] = " ".join([words(8), *[f"{x} {words(4)}" for x, has in shared.items() if has]])
        rows.append((i, "http://prose/x", f"<p>{own[i]}</p><div>all rights to these pages are with their many writers</div>"))
    rows += [(100 + i, "http://prose/x", f"<p>{passage}</p><p>{words(20)}</p>") for i in range(4)]
    out = {r.page_id: r.text for r in H.extract(pages_of(spark, rows), ["page_id"]).collect()}
    assert {i: out[i] for i in own} == own and all(out[100 + i].startswith(passage) for i in range(4))


def test_blocks_of_articles_stay_also_where_others_have_them(spark):
    plea = "please send this story to all your friends"
    rows = [(i, "http://h/x", f"<article><p>story {i} of a{i} b{i} c{i} d{i} e{i} f{i}</p><p>{plea}</p></article>") for i in range(8)]
    df = pages_of(spark, rows)
    for size in (1 << 20, 100):
        out = {r.page_id: (r.text, r.n_repeated) for r in H.extract(df, ["page_id"], shard_bytes=size).collect()}
        assert out == {i: (f"story {i} of a{i} b{i} c{i} d{i} e{i} f{i} {plea}", 0) for i in range(8)}


def test_names_of_layout_and_topics_lose_no_text():
    body = "<p>one two three four</p><p>five six</p>"
    for page in (
        f'<div id="content-sidebar-wrap"><article>{body}</article></div>',
        f'<article class="post comments-open">{body}</article>',
        f'<form id="aspnetForm"><input><article>{body}</article><button>go</button></form>',
        f'<article>{body.replace("<p>five", chr(60) + "p class=share-price>five")}</article>',
        f'<div class="sidebar-layout">{body}</div>',
        f'<form>{body}</form>',
        f'<body class="widget-page"><div class="banner-content">{body}</div><nav>menu</nav>',
        f'<div class="has-sidebar"><main>{body}</main><div class="sidebar">side</div></div>',
    ):
        assert kept(page) == "one two three four five six", page
    assert kept(f'<article>{body}<section id="related-work"><p>seven</p></section></article>').endswith("six seven")


def test_comments_go_whatever_their_size():
    thread = "<article class='comment'><p>" + "so long a thread " * 40 + "</p></article>"
    assert kept(f"<article><p>short story</p><section id=comments>{thread}</section></article>") == "short story"
    assert kept(f"<div><p>short story</p></div><ol class='comment-list'><li>{thread}</li></ol>") == "short story"
    assert kept(f"<article><p>short story</p></article><div class='related-posts'>{'more ' * 90}</div>") == "short story"
    assert kept("<article><p>a b c d</p><div class='newsletter-signup-box'>join us</div><span class=ad>x</span> e</article>") == "a b c d e"


def brute_texts(pages, long=H.LONG, run=H.LONG_RUN, share=H.SHARE, least=H.MIN_PAGES):
    """The text of every page of one host, by comparing all its streams word by word."""
    cut = [H.blocks_of(p) for p in pages]
    streams = [tuple(w for part, b in c if part != H.MAIN for w in b.split()) for c in cut]
    grams = [{s[i : i + long] for i in range(len(s) - long + 1)} for s in set(streams)]
    often = {g for own in grams for g in own if sum(g in x for x in grams) >= max(least, -(-share * len(grams) // 1))}
    out = []
    for c, s in zip(cut, streams):
        mask, at, kept_blocks = [False] * len(s), 0, []
        for i in range(len(s) - long + 1):
            if s[i : i + long] in often:
                mask[i : i + long] = [True] * long
        for part, block in c:
            words = block.split()
            if part == H.MAIN:
                kept_blocks.append(block)
                continue
            own, at = mask[at : at + len(words)], at + len(words)
            if part == H.OPEN and not all(own):
                drop = [False] * len(own)
                for i in range(len(own)):
                    a = i
                    while a >= 0 and own[a]:
                        a -= 1
                    b = i
                    while b < len(own) and own[b]:
                        b += 1
                    drop[i] = own[i] and b - a - 1 >= run
                kept_blocks.append(" ".join(w for w, d in zip(words, drop) if not d))
        out.append((" ".join(b for b in kept_blocks if b), sum(mask)))
    return out


def test_whole_host_against_brute_force(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(n))
    notices = [words(n) for n in (6, 9, 14, 30)]
    pages = []
    for _ in range(45):
        parts = [f"<p>{words(rng.randint(0, 14))}</p>" for _ in range(rng.randint(1, 4))]
        parts += [f"<div>{rng.choice(['', words(3)])} {rng.choice(notices)} {rng.choice(['', words(4)])}</div>" for _ in range(rng.randint(0, 3))]
        rng.shuffle(parts)
        if rng.random() < 0.3:
            parts.insert(1, f"<article><p>{words(9)}</p><p>{notices[1]}</p></article>")
        pages.append("".join(parts))
    pages += pages[:3]
    want = brute_texts(pages)
    assert sum(n > 0 for _, n in want) > 15
    df = pages_of(spark, [(i, "http://one/x", p) for i, p in enumerate(pages)])
    for size in (1 << 20, 700):
        out = {r.page_id: (r.text, r.n_repeated) for r in H.extract(df, ["page_id"], shard_bytes=size).collect()}
        assert [out[i] for i in range(len(pages))] == want
