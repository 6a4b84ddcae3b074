"""URL, HTML, page store, crawl tables and relational blocks."""

import struct

import pytest
from pyspark.sql import functions as F

from gossamer.functions import html as H
from gossamer.functions import url as U
from gossamer.operators import crawl as C
from gossamer.operators import relational as R
from gossamer.sources import formats as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (" HTTP://WWW.A.com.:8080/x/y.html;p?q=1#f ", ("HTTP", "www.a.com", "8080", "/x/y.html", "p", "q=1", "f")),
        ("http://a.com", ("http", "a.com", "", "/", "", "", "")),
        ("../up?x", ("", "", "", "../up", "", "x", "")),
        ("", ("", "", "", "", "", "", "")),
    ],
)
def test_parse(spark, url, want):
    assert tuple(one(spark, url, U.parse)) == want


def test_null_and_long_urls(spark):
    assert one(spark, None, U.canonical) is None
    assert one(spark, "x" * 200_000, U.canonical) is None


@pytest.mark.parametrize(
    ("rel", "want"),
    [("d.html", "http://h/a/b/d.html"), ("../d", "http://h/a/d"), ("../../../d", "http://h/../d"), ("/z?q", "http://h/z?q"), ("//o/p", "http://o/p"), ("", "http://h/a/b/c"), ("./e", "http://h/a/b/e"), ("https://k", "https://k/"), ("#x", "http://h/a/b/c")],
)
def test_resolve(spark, rel, want):
    assert one(spark, rel, lambda c: U.resolve(c, F.lit("http://h:80/a/b/c"))) == want


def test_hashes_and_ids(spark):
    assert U.crc(b"123456789", 0x04C11DB7, 32, 0xFFFFFFFF) == 0x0376E6E7
    assert U.crc(b"123456789", 0xE543279765927881, 64, (1 << 64) - 1) == 0x44F0026F7CFAA3EC
    df = spark.createDataFrame([("123456789",), (None,), ("",)], "x string")
    rows = df.select(U.header_crc32("x").alias("a"), U.page_crc64("x").alias("b"), U.string_hash(F.col("x")).alias("c")).collect()
    assert (rows[0].a, rows[0].b, rows[0].c) == (0x0376E6E7, 0x44F0026F7CFAA3EC, 0x340BC6D9)
    assert rows[1].a is None and rows[2].a == 0xFFFFFFFF
    assert one(spark, -1, U.padded, "bigint") == "18446744073709551615"
    assert one(spark, -1, U.bucket, "bigint") == 63
    assert one(spark, "a\nb \x7f", lambda c: U.encode_unsafe(c, False)) == "a%0:b%20%7?"
    assert one(spark, "a\nb", U.encode_unsafe) == "a%0Ab"


@pytest.mark.parametrize(("host", "want"), [("abc.mp3.com", "com/mp3/abc"), (".abc.mp3.com", "com/mp3/abc/_dot_"), ("abc.mp3.com.", "_dot_/com/mp3/abc"), ("", "_dot_")])
def test_site_path(spark, host, want):
    assert one(spark, host, lambda c: U.site_path(c, "/p/", "text")) == f"/p/{want}/_repository_/text"


@pytest.mark.parametrize(("path", "want"), [("/a.HTM", "text"), ("/a.mp3", "audio"), ("/a.gif", "image"), ("/a.mp3/", "text"), ("/a", "text"), ("/a.xyz", "unknown"), ("/a.x", "text")])
def test_file_type(spark, path, want):
    assert one(spark, path, U.file_type) == want


def test_links(spark):
    page = '<BASE href="http://b/x/"><a class=z HREF = \'one.html\'>1</a><img src="i.gif"><!-- a <A href="x1"> b <A href="x2"> --><a name="n">no</a><area href=two&amp;3>'
    got = one(spark, page, lambda c: F.transform(H.links(c, "clean"), lambda x: x["link"]))
    assert got == ["http://b/x/", "one.html", "i.gif", "two&3"]
    assert "x2" in one(spark, page, lambda c: F.transform(H.links(c), lambda x: x["link"]))
    pages = spark.createDataFrame([(1, "http://h/p/q", page), (2, None, page), (3, "http://h/", None)], "id int, url string, page string")
    assert {(r.pos, r.target) for r in H.page_links(pages, "id", "url", "page").collect()} == {(1, "http://b/x/one.html"), (6, "http://b/x/two&3")}


def test_text_functions(spark):
    assert one(spark, "<p>one <b>t</b>wo&nbsp;x</p><!-- c -->", H.inline_text) == "one two x"
    assert one(spark, "a<b>b</b>", H.plain_text) == "a b"
    assert one(spark, "HTTP/1.0 302 F\r\nLocation: http://x/\r\n\r\nbody", H.http_header).endswith("\r\n\r\n")
    assert one(spark, "HTTP/1.0 302 F\r\n\r\nbody", H.body_of) == "body"
    assert one(spark, "HTTP/1.0 302 F", H.response_class) == "redirect"
    assert one(spark, "&eacute;&#65;&trade;&nope;", lambda c: H.latin1_entities(c)) == "éA\x99 "
    robots = spark.createDataFrame([("s", "User-agent: *\nDisallow: /all\n\nUser-agent: WebBot # me\nDisallow: /mine\nDisallow:\n"), ("t", None)], "site string, text string")
    assert [r.prefix for r in H.robots_rules(robots, "site", "text", "webbot").collect()] == ["/mine"]
    assert [r.prefix for r in H.robots_rules(robots, "site", "text", "other").collect()] == ["/all"]


def test_page_store_survives_damage(spark, tmp_path):
    records = [S.pack_page(f"http://h/{k}", "HTTP/1.0 200 OK", b"Hello World", 7) for k in range(3)]
    broken = bytearray(records[1])
    broken[40] ^= 255
    data = b"junk" + records[0] + bytes(broken) + records[2]
    assert [r[2] for r in S.unpack_pages(data)] == ["http://h/0", "http://h/2"]
    (tmp_path / "c1").write_bytes(data)
    rows = S.read_page_store(spark, str(tmp_path)).collect()
    assert {r.url for r in rows} == {"http://h/0", "http://h/2"} and bytes(rows[0].body) == b"Hello World"
    assert struct.unpack(">I", records[0][:4])[0] == S.MAGIC


def test_page_store_by_site(spark, tmp_path):
    pages = spark.createDataFrame([("a", 0, "x"), ("a", 9, "y"), ("b", 0, None)], "site string, offset bigint, body string")
    path = str(tmp_path / "store")
    S.write_page_store(pages, path, "site")
    S.write_page_store(pages.filter("site = 'b'"), path, "site")
    assert S.scan_page_store(spark, path).count() == 4
    assert [r.body for r in S.scan_page_store(spark, path, "a", offset=5).collect()] == ["y"]
    assert {(r.site, r.num_pages) for r in S.site_sizes(S.scan_page_store(spark, path), "site").collect()} == {("a", 2), ("b", 2)}
    plan = S.scan_page_store(spark, path, "a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.metis").write_text("% c\n3 2 001\n2 5\n1 5 3 7\n2 7\n")
    v, e = S.read_metis(spark, str(tmp_path / "g.metis"))
    assert v.count() == 3 and {(r.src, r.dst, r.weight) for r in e.collect()} == {(0, 1, 5), (1, 2, 7)}
    (tmp_path / "g.dim").write_text("c x\np sp 3 2\na 1 2 4\na 2 3 1\n")
    n, e = S.read_dimacs(spark, str(tmp_path / "g.dim"))
    assert n == 3 and {(r.src, r.dst, r.weight) for r in e.collect()} == {(0, 1, 4), (1, 2, 1)}
    (tmp_path / "parts").write_text("1\n0\n")
    assert {(r.id, r.part) for r in S.read_metis_parts(spark, str(tmp_path / "parts")).collect()} == {(0, 1), (1, 0)}
    lines = [r.line for r in S.dot_lines(spark.range(2), spark.createDataFrame([(0, 1, 0)], "src bigint, dst bigint, eid bigint")).collect()]
    assert lines == ["digraph g {", "subgraph cluster_0 {", "  n0;", "  n1;", "}", "n0 -> n1;", "}"]
    assert one(spark, 0, S.paint, "int") == ' [ style="filled", fillcolor="blue" ]' and one(spark, 24, S.paint, "int") == ' [ label="(24)" ]'
    (tmp_path / "more").write_text("b = 2\n")
    (tmp_path / "conf").write_text("# c\na = x y\ninclude more\n")
    assert S.load_conf(str(tmp_path / "conf")) == {"a": "xy", "b": "2"}
    (tmp_path / "pairs").write_text("1 2\n3 4\n")
    assert [r.value for r in S.pair_text(S.text_pairs(spark, str(tmp_path / "pairs"))).orderBy("value").collect()][0] == "0" * 19 + "1\t" + "0" * 19 + "2"


def test_relational_blocks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, "b")], "k int, x string")
    assert [r.k for r in R.drop_consecutive(df.filter("x IS NOT NULL"), F.col("x"), ["k"]).orderBy("k").collect()] == [1, 4]
    assert {r.k for r in R.max_with_ties(df, "x").collect()} == {4, 5}
    scan = R.prefix_scan(spark.range(10).select("id", F.col("id").alias("v")), "v", "id", "s")
    assert [r.s for r in scan.orderBy("id").collect()] == [0, 1, 3, 6, 10, 15, 21, 28, 36, 45]
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 0), (None, 3), (4, None), (5, 6)], "a bigint, b bigint")
    lists = R.link_lists(e, "a", "b")
    assert {(r.src, r.n) for r in lists.collect()} == {(1, 1), (5, 1)}
    assert {r.offset for r in R.list_offsets(lists).collect()} == {0, 24}
    diff = R.compare_streams(df, df.filter("k < 5"), "k", "x")
    assert [r.pos for r in diff.collect()] == [5]


def test_crawl_tables(spark):
    un = spark.createDataFrame([(1, "10.0.0.9"), (2, "10.0.0.2")], "hid bigint, ipaddr string")
    busy = spark.createDataFrame([(9, 3, "10.0.0.9")], "hid bigint, id int, ipaddr string")
    assert C.next_site(un, busy).first().hid == 2
    left, crawling = C.claim(un, busy, 4)
    assert left.count() == 1 and crawling.filter("id = 4").first().hid == 2
    ips = spark.createDataFrame([(1, "10.0.0.10"), (1, "9.1.1.1")], "hid bigint, ipaddr string")
    assert {(r.hid, r.ipaddr) for r in C.first_addresses(un.select("hid"), ips).collect()} == {(1, "9.1.1.1"), (2, None)}
    log = spark.createDataFrame([("x SiteDone: a.com 3",), ("none",)], "line string")
    assert [r.host for r in C.finished_sites(log, "line").collect()] == ["a.com"]


@pytest.mark.parametrize("sent", [500_000, 0])
def test_rows_once_each(spark, tmp_path, monkeypatch, sent):
    from gossamer import session
    from gossamer.session import once_each

    monkeypatch.setattr(session, "MAX_SENT_KEYS", sent)
    rows = [(k % 7, f"text {k % 7}") for k in range(20)] + [(None, "x"), (100, None)]
    spark.createDataFrame(rows, "id bigint, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    got = once_each(spark.read.parquet(str(tmp_path / "t")), "id")
    assert sorted(r.id for r in got.filter("id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 5, 6, 100] and got.columns == ["id", "text"]


def test_running_sums_within_groups(spark):
    rows = [(k, k % 3, k * 2) for k in range(100)]
    df = spark.createDataFrame(rows, "k bigint, g int, v bigint").repartition(5)
    got = {r.k: r.s for r in R.prefix_scan(df, "v", "k", "s", "g", False).collect()}
    assert got == {k: sum(x * 2 for x in range(k) if x % 3 == k % 3) for k in range(100)}
    assert {r.k: r.s for r in R.prefix_scan(df, "v", "k", "s").collect()} == {k: sum(2 * x for x in range(k + 1)) for k in range(100)}
    assert R.prefix_scan(df.limit(0), "v", "k", "s").isEmpty()


def test_sites_take_turns(spark):
    urls = [(k, f"u{k}", k % 4) for k in range(20)]
    df = spark.createDataFrame(urls, "at bigint, u string, site int")
    counters = spark.createDataFrame([(0, 1, 0, 9, 0), (1, 2, 0, 9, 0), (2, 0, 8, 4, 0)], "site int, waiting int, errors int, successes int, in_row int")
    got = {(r.site, r.turn, r.at) for r in C.take_turns(df, "site", ["at"], counters).collect()}
    assert got == {(0, 0, 0), (3, 0, 3), (3, 1, 7)}


def test_queue_state_is_kept(spark, tmp_path):
    state = {"frontier": spark.createDataFrame([(1, "u")], "id bigint, u string"), "seen": spark.createDataFrame([], "h bigint")}
    C.save_queue(state, str(tmp_path / "s"))
    back = C.load_queue(spark, str(tmp_path / "s"), ["frontier", "seen"])
    assert back["frontier"].collect() == state["frontier"].collect() and back["seen"].isEmpty()


def test_fields_and_ascii_letters(spark):
    r = spark.createDataFrame([(":a::b:", "ÄBc")], "a string, b string").select(H.split_fields(F.col("a"), ":").alias("f"), H.ascii_lower(F.col("b")).alias("l")).first()
    assert r.f == ["", "a", "", "b", ""] and r.l == "Äbc"
