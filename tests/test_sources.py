import datetime as dt

from pyspark.sql import functions as F

from storyline.sources import feeds, pages, sinks


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><description>d</description><content:encoded><![CDATA[<p>long</p>]]></content:encoded><pubDate>x</pubDate></item><item><title> </title></item><item><title>broken"
    atom = '<feed><entry><title type="html">E</title><link rel="alternate" href="http://y/2"/><summary>s</summary><published>2024</published></entry></feed>'
    got = {(r.source, r.title, r.link, r.description, r.date) for r in feeds.feed_items(spark.createDataFrame([("r", rss), ("a", atom)], "source string, payload string")).collect()}
    assert got == {("r", "A & B", "http://x/1", "<p>long</p>", "x"), ("a", "E", "http://y/2", "s", "2024")}


def test_digest_and_ledger(spark):
    text = "head\n" + "=" * 50 + "\n[2] Src - Title - more\nTarih: 01.01.2024\nLink: http://x\n\nBody text.\n" + "=" * 50
    row = feeds.digest_articles(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.id, row.source, row.title, row.date, row.link, row.body) == (2, "Src", "Title - more", "01.01.2024", "http://x", "Body text.")
    lines = ["2024-01-08\thttp://a\tone\ttwo\t" + "a" * 32, "2024-01-07\thttp://b\tplain", "bad\tx\ty", "2023-12-01\thttp://c\told", "short"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    got = [(str(r.day), r.title, r.content_hash) for r in feeds.seen_links(df, F.lit("2024-01-01").cast("date")).orderBy("day").collect()]
    assert got == [("2024-01-07", "plain", None), ("2024-01-08", "one\ttwo", "a" * 32)]


def test_failed_sources(spark):
    lines = ["2024-01-08 10:00 | RSS hatası - Src A: timeout", "2024-01-08 10:00 | other - Src B: x", "2023-01-08 10:00 | RSS hatası - Src C: x", "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.source for r in feeds.failed_sources(df, F.lit("2024-01-01").cast("timestamp"), ["RSS hatası"]).collect()] == ["Src A"]


SHAPES = [
    ('{"1": {"tr_title": "x"}, "2": {"paragraph": "y"}}', {1: '{"tr_title":"x"}', 2: '{"paragraph":"y"}'}),
    ('{"3": {"tr_title": "only"}}', {3: '{"tr_title":"only"}'}),
    ('[{"72": {"tr_title": "a"}, "29": {"tr_title": "b"}}]', {72: '{"tr_title":"a"}', 29: '{"tr_title":"b"}'}),
    ('[{"8": {"tr_title": "a"}}, {"13": {"tr_title": "b"}}, 5, "x", null]', {8: '{"tr_title":"a"}', 13: '{"tr_title":"b"}'}),
    ('[{"tr_title": "a", "paragraph": null}, {"paragraph": "b"}]', {"asked": ['{"paragraph":null,"tr_title":"a"}', '{"paragraph":"b"}']}),
    ('{"items": [{"tr_title": "a"}, {"tr_title": "b"}]}', {"asked": ['{"tr_title":"a"}', '{"tr_title":"b"}']}),
    ('[{"tr_title": "a"}]', {}),
    ('[{"tr_title": "a"}, {"id": 2, "tr_title": "b"}]', {2: '{"id":2,"tr_title":"b"}'}),
    ('{"summaries": {"3": {"tr_title": "x"}}}', {3: '{"tr_title":"x"}'}),
    ('{"a": {"b": {"c": [{"d": {"e": {"4": {"paragraph": "deep"}}}}]}}}', {4: '{"paragraph":"deep"}'}),
    ('[{"id": 3, "tr_title": "x"}, {"ID": "4", "v": 1}, {"Id": "no"}]', {3: '{"id":3,"tr_title":"x"}', 4: '{"ID":"4","v":1}'}),
    ('[{"5": {"tr_title": "first"}}, {"5": {"tr_title": "last"}}]', {5: '{"tr_title":"last"}'}),
    ('<think>{"9": {"tr_title": "no"}}</think> {"1": {"tr_title": "{x}"}} and {"2": {"tr_title": "no"}}', {1: '{"tr_title":"{x}"}'}),
    ('Well:\n```json\n{"6": {"tr_title": "f"}}\n``` }', {6: '{"tr_title":"f"}'}),
    ('{"7": {"tr_title": "cut"', {}),
    ("no json", {}), ("", {}), (None, {}), ("[]", {}), ("{}", {}), ("null", {}), ("[1, 2]", {}), ('"sorry"', {}), ('{"note": "x", "n": 3}', {}), ("} {", {}),
]


def test_answers_of_any_shape(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SHAPES)], "batch int, text string").repartition(3)
    asked = spark.createDataFrame([(k, i, s) for k in range(len(SHAPES)) for s, i in enumerate((900 + k, 100 + k))], "batch int, article_id long, seq int")
    rows = feeds.answers(df, asked).collect()
    got = {}
    for r in rows:
        got.setdefault(r.batch, {})[r.article_id] = r.value
    for k, (text, want) in enumerate(SHAPES):
        assert got.get(k, {}) == (dict(zip((900 + k, 100 + k), want["asked"], strict=True)) if "asked" in want else want), text
    assert len(rows) == sum(len(x) for x in got.values())
    assert {r.batch for r in feeds.answers(df).collect()} == {k for k in got if "asked" not in SHAPES[k][1]}
    assert feeds.answers(df.where("false"), asked).count() == 0
    shapes = {r["shape"]: r.n for r in feeds.unusable(df, asked).collect()}
    assert shapes == {"array 1 of object tr_title": 1, "none": 5, "array 0": 1, "object": 1, "null": 1, "array 2 of number": 1, "string": 1, "object n,note": 1}


def test_answers_by_other_fields(spark):
    df = spark.createDataFrame([(0, '{"articles": {"3": {"a": 1}}}'), (1, '{"rows": [{"key": 4, "a": 1}, {"key": 5}]}')], "batch int, text string")
    assert sorted(r.article_id for r in feeds.answers(df, ids=("key",), content=("a",)).collect()) == [3, 4, 5]


def test_pages(spark):
    para = "This is a long enough paragraph of text for the page. " * 12
    html = f"<html><body><nav><li>Home of all the things here</li></nav><article><p>{para}</p><p>Please subscribe to our newsletter today</p></article><a href='/news/12345'>A fitting title of a story</a><a href='http://z.com/99999'>Other host with a title</a></body></html>"
    parts = pages.page_parts(spark.createDataFrame([(1, "http://www.x.com/a", html), (2, None, None)], "page_id long, url string, html string"))
    main = pages.main_text(parts).collect()
    assert len(main) == 1 and main[0].strategy == "article" and "newsletter" not in main[0].text
    assert [(r.url, r.title) for r in pages.expanded_links(parts).collect()] == [("https://x.com/news/12345", "A fitting title of a story")]


def test_long_pages_are_read_to_their_end(spark):
    para = "<p>This is a long enough paragraph of text for the page.</p>"
    html = f"<html><body><main>{'<p>short</p>' * 50_000}{para * 12}</main><a href='/news/12345'>A fitting title of a story</a></body></html>"
    assert html.index(para) > 500_000
    parts = pages.page_parts(spark.createDataFrame([(1, "http://www.x.com/a", html)], "page_id long, url string, html string"))
    assert [(r.strategy, r.n_words) for r in pages.main_text(parts).collect()] == [("main", 132)]
    assert [r.url for r in pages.expanded_links(parts).collect()] == ["https://x.com/news/12345"]


def words(n, w="lorem"):
    return " ".join([w] * n)


def of_pages(spark, *htmls):
    return spark.createDataFrame([(k, "http://www.x.com/a", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def test_selectors_of_a_source_come_first(spark):
    hundred = f"<p>{words(101)}</p>"
    rows = [("x.com", 0, None, "entry", None), ("x.com", 1, "section", None, "text"), ("other.com", 0, "aside", None, None)]
    selectors = spark.createDataFrame(rows, "source string, rank int, name string, class string, id string")
    pages_of = of_pages(
        spark,
        f"<div class='big entry'>{hundred}</div><article>{hundred}</article>",  # one of several classes
        f"<div class='entry'><p>too short</p></div><section id=text>{hundred}</section><article>{hundred}{hundred}</article>",  # the first that exists is meant, though it is empty
        f"<section class=x id=text>{hundred}</section><section id=text>{hundred}{hundred}</section><article>{hundred}</article>",  # the first of its kind
        f"<p id=text>{words(200)}</p><aside>{hundred}</aside><main></i><p>{words(60)}<p>{words(60)}</main><footer>{hundred}</footer>",  # no section; paragraphs without an end
        f"<article><p>short</p></article><div class='sidebar'>{hundred}</div><div class='post-body'><div>{hundred}</div></div>{hundred}",
        f"<article><p>{words(100)}</p></article>",  # not over a hundred
        None,
    )
    parts = pages.page_parts(pages_of, selectors)
    found = {r.page_id: (r.strategy, r.n_words) for r in pages.main_text(parts).collect()}
    assert found == {0: (".entry", 101), 1: ("article", 202), 2: ("section#text", 101), 3: ("main", 120), 4: ("div", 101)}
    rows = {(r.own, r.strategy): (r.n_pages, r.n_enough, r.n_chosen, r.max_words, r.proposed) for r in pages.extractor_yield(parts).collect()}
    assert rows == {
        (True, ".entry"): (2, 1, 1, 101, True), (True, "section#text"): (2, 2, 1, 101, False), (False, "article"): (5, 3, 1, 202, False), (False, "main"): (1, 1, 1, 120, False), (False, "div"): (1, 1, 1, 101, False),
    }
    same_names = spark.createDataFrame([("x.com", 0, "article", None, None)], selectors.schema)
    assert {(r.own, r.n_chosen) for r in pages.extractor_yield(pages.page_parts(of_pages(spark, f"<article>{hundred}</article>"), same_names)).collect()} == {(True, 1), (False, 0)}


def test_pages_added_by_hand(spark):
    fifty, once = f"<p>{words(50)}</p>", "<p>A line that is printed twice on this page</p>"
    pages_of = of_pages(
        spark,
        f"<article>{fifty}{once}<nav>{fifty}</nav>{once}<h4>{words(5)}</h4></article>",
        f"<article>{once}</article><main>{fifty}</main>",
        f"<article>{fifty}</article><div id='news-body-1'>{once}<div class=story>{fifty}</div></div>",
        f"<article>{once}</article><section class=haber><p>{words(20)}</p><div class=entry><p>{words(20, 'ipsum')}</p></div></section><div class=post><p>{words(30)}</p></div><aside>{fifty}</aside>",
        f"<form>{fifty}</form>{once}<p>{words(12)}</p>",
        f"<meta name=description content='What it is  about'><meta property='og:description' content='Told again'>{once}",
        "<p>Kişisel verilere dair çerez bildirimi</p>",  # no part that counts
    )
    found = {r.page_id: (r.strategy, r.n_words) for r in pages.edited_text(pages.page_parts(pages_of)).collect()}
    assert found == {0: ("article", 64), 1: ("main", 50), 2: ("article", 50), 3: ("page", 79), 4: ("page", 21), 5: ("page", 15), 6: ("none", 0)}


def test_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    day = dt.date(2024, 1, 1)
    for value in (1, 2):
        sinks.write_day(spark.createDataFrame([(day, value)], "day date, v int"), path)
    sinks.write_day(spark.createDataFrame([(dt.date(2024, 1, 2), 3)], "day date, v int"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]
    assert [r.v for r in sinks.read_days(spark, path, "2024-01-01", "2024-01-02").collect()] == [2]
