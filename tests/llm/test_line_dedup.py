from collections import Counter, defaultdict

from counterscope.llm.line_dedup import drop_boilerplate, host_of, lines_of

PAGES = "page_id long, url string, html string"


def test_lines_and_hosts(spark):
    html = "<p>One  <b>two</b><br/>three</p><script>var x='</p>';</script><!-- no\n --><DIV class=a>four</DIV> five\n\nsix"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(lines_of(df.html)).first()[0] == ["One two", "three", "four", "five", "six"]
    urls = ["http://A.example:80/x", "https://u:p@b.example?q", "no host", None, "//c.example/", "ftp://d.example#x"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(host_of(df.url)).collect()] == ["a.example", "b.example", None, None, None, "d.example"]


def test_frequency_is_relative_to_the_host(spark):
    rows = []
    for i in range(40):
        menu = "<li>Home</li>" * 2 + ("<li>Sale</li>" if i % 4 == 0 else "")
        rows.append((i, f"http://big.example/{i}", f"{menu}<p>story {i}</p><p>shared story</p>" if i < 10 else f"{menu}<p>story {i}</p>"))
    rows += [(100 + i, "http://small.example/", "<p>Home</p><p>x</p>") for i in range(2)]
    rows += [(200, None, "<p>Home</p>"), (201, "http://big.example/", None), (202, "http://none.example", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS host", "2 AS lines", "'x' AS text")
    got = drop_boilerplate(df, ratio=0.3, least_pages=3)
    lines = {i: [x for x in (h or "").replace("</p>", "\n").replace("</li>", "\n").replace("<p>", "").replace("<li>", "").split("\n") if x]
             for i, h in enumerate(r[2] for r in rows)}
    pages, having = Counter(), defaultdict(Counter)
    host = lambda u: u.split("/")[2] if u else None
    for i, r in enumerate(rows):
        pages[host(r[1])] += 1
        having[host(r[1])].update(set(lines[i]))
    want = []
    for i, r in enumerate(rows):
        h = host(r[1])
        kept = [x for x in lines[i] if h is None or not (having[h][x] >= 3 and having[h][x] > 0.3 * pages[h])]
        want.append((r[0], h, len(lines[i]), len(lines[i]) - len(kept), "\n".join(kept)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[3] for w in want} >= {0, 2} and "shared story" in want[0][4]


def test_empty_table(spark):
    assert drop_boilerplate(spark.createDataFrame([], PAGES)).count() == 0
