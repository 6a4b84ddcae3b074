"""Web, crawl-table and link-table queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import url as U
from ..operators import crawl as C
from ..operators import relational as R
from ..session import once_each, table
from ..streaming import jobs

PREFIXES, SUBSTRINGS = ["/cgi", "/z"], ["sid=", "calendar"]
QUERY = '"link" pages'


def _pages(spark, d):
    """Pages once each: a request delivered twice counts once.  Page bodies aren't shuffled."""
    return once_each(table(spark, d, "responses"), "request_id")


def _fetches(spark, d):
    """The narrow columns of the pages, once each."""
    narrow = table(spark, d, "responses").withColumn("stored", F.col("page").isNotNull()).drop("page")
    return narrow.dropDuplicates(["request_id"])


def url_parse(spark, d):
    p = U.parse(F.col("u"))
    return table(spark, d, "url_queue").filter("u IS NOT NULL").select("entry_id", p.alias("p")).select("entry_id", "p.*")


def url_canonical(spark, d):
    return table(spark, d, "url_queue").filter("u IS NOT NULL").select("entry_id", U.canonical(F.col("u")).alias("url"))


def ext_type(spark, d):
    p = table(spark, d, "url_queue").filter("u IS NOT NULL").select("entry_id", U.parse(F.col("u"))["path"].alias("path"))
    return p.select("entry_id", U.extension(F.col("path")).alias("ext"), U.file_type(F.col("path")).alias("kind"))


def url_fields(spark, d):
    p = table(spark, d, "url_queue").filter("u IS NOT NULL").select("entry_id", F.explode(U.query_fields(U.parse(F.col("u"))["query"])).alias("name", "value"))
    return p


def url_filter_code(spark, d):
    q = table(spark, d, "url_queue").filter("u IS NOT NULL")
    code = C.filter_code(U.parse(F.col("u")), F.coalesce("seed_level", F.lit(0)), F.col("seed_id"), PREFIXES, SUBSTRINGS, ["text"], 4, 5)
    return q.select("entry_id", code.alias("code"))


def url_hashes(spark, d):
    """Hashes of the addresses: seen-set hash, header CRC, page CRC and document id."""
    q = table(spark, d, "url_queue").filter("u IS NOT NULL")
    return q.select("entry_id", U.url_hash(U.parse(F.col("u"))).alias("url_hash"), U.header_crc32("u").alias("crc32"), U.page_crc64("u").alias("crc64"), U.doc_id(F.col("u")).alias("doc_id"))


def reverse_host(spark, d):
    h = table(spark, d, "hosts").filter("hostname IS NOT NULL")
    return h.select("hid", U.reverse_host(F.col("hostname")).alias("reversed"), U.site_path(F.col("hostname"), "/pages/", "text").alias("folder"))


def id_forms(spark, d):
    h = table(spark, d, "hash_log").filter("ha_hv IS NOT NULL")
    return h.select("rec_id", U.bucket(F.col("ha_hv")).alias("bucket"), U.lose_slash(F.col("ha_hv")).alias("even"), U.padded(F.col("ha_hv")).alias("unsigned"))


def links_extract(spark, d):
    return _pages(spark, d).filter("page IS NOT NULL").select("request_id", H.exploded(H.links(F.col("page"))).alias("l")).filter("l IS NOT NULL").select("request_id", "l.pos", "l.tag", "l.link")


def links_resolved(spark, d):
    p = H.page_links(_pages(spark, d), "request_id", "page_url", "page")
    return p.select("request_id", "pos", "link", "target")


def followed_inside(spark, d):
    """Links that stay on a server of their page's site."""
    names = table(spark, d, "queue_info").select("queue_id", "site_names")
    site = _fetches(spark, d).select("request_id", "queue_id")
    l = H.page_links(_pages(spark, d), "request_id", "page_url", "page").join(site, "request_id").join(names, "queue_id")
    return l.filter(C.same_server(U.parse(F.col("target"))["net_loc"], F.col("site_names"))).groupBy("queue_id").agg(F.count(F.lit(1)).alias("n"))


def html_plain(spark, d):
    return _pages(spark, d).filter("page IS NOT NULL").select("request_id", H.plain_text(F.col("page")).alias("words"), H.letter_count(F.col("page")).alias("letters"))


def html_inline(spark, d):
    return _pages(spark, d).filter("page IS NOT NULL").select("request_id", H.inline_text(F.col("page")).alias("words"))


def html_entities(spark, d):
    return _pages(spark, d).filter("page LIKE '%&%'").select("request_id", H.latin1_entities("page").alias("page"))


def robots_rules(spark, d):
    """Rules for all agents in the robots-like lists among the documents."""
    lists = table(spark, d, "documents").filter("kind = 'list' AND text IS NOT NULL").select("doc_id", F.concat(F.lit("User-agent: *\n"), F.col("text")).alias("text"))
    return H.robots_rules(lists, "doc_id", "text", "crawler")


def host_counts(spark, d):
    l = H.page_links(_pages(spark, d), "request_id", "page_url", "page")
    return l.select(U.parse(F.col("target"))["net_loc"].alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def fwd_links(spark, d):
    return R.link_lists(table(spark, d, "edges"), "from_id", "to_id")


def fwd_links_256(spark, d):
    return R.link_lists(table(spark, d, "edges"), "from_id", "to_id", 256)


def back_links(spark, d):
    return R.back_links(table(spark, d, "edges"), "from_id", "to_id")


def list_offsets(spark, d):
    return R.list_offsets(fwd_links(spark, d))


def list_fetch(spark, d):
    """The link lists of the sites' roots, read by the offsets of their lists."""
    lists = fwd_links(spark, d)
    offsets = R.list_offsets(lists)
    roots = table(spark, d, "queue_info").select(F.col("root_docid").alias("src")).filter("src IS NOT NULL").distinct()
    asked = offsets.join(roots, "src", "left_semi").select("bucket", "offset")
    return R.fetch_lists(lists, offsets, asked)


def host_words(spark, d):
    """Host names in small ASCII letters and cut at dots and slashes, empty fields kept."""
    h = table(spark, d, "hosts").filter("hostname IS NOT NULL")
    return h.select("hid", H.ascii_lower(F.col("hostname")).alias("lower"), H.split_fields(F.col("hostname"), "./").alias("fields"), H.split_nonempty(F.col("hostname"), "./").alias("words"))


def valid_ids(spark, d):
    """Edges whose ids are valid: above 10000 or negative."""
    ok = lambda c: (F.col(c) > 10000) | (F.col(c) < 0)
    return table(spark, d, "edges").filter(ok("from_id") & ok("to_id")).select("edge_id")


def link_lookup(spark, d):
    """Addresses that link to a site's root, found through the ids."""
    page = table(spark, d, "responses").filter("page_url IS NOT NULL").groupBy("docid").agg(F.min("page_url").alias("url"))
    roots = table(spark, d, "queue_info").select("queue_id", "root_docid")
    hits = table(spark, d, "edges").join(roots, F.col("to_id") == F.col("root_docid")).select("queue_id", "from_id").distinct()
    return hits.join(page, hits.from_id == page.docid).select("queue_id", "from_id", "url")


def sort_unique_merge(spark, d):
    e = table(spark, d, "edges").select("from_id", "to_id", "edge_id").filter("from_id IS NOT NULL AND to_id IS NOT NULL")
    old, new = e.filter("edge_id % 2 = 0"), e.filter("edge_id % 2 <> 0")
    return R.sort_unique_merge(new, old, ["from_id", "to_id"])


def dedupe_consecutive(spark, d):
    return R.drop_consecutive(table(spark, d, "url_queue").filter("u IS NOT NULL"), F.col("u"), ["entry_id"], ["queue_id"]).select("queue_id", "entry_id")


def seen_set(spark, d):
    q = table(spark, d, "url_queue").filter("u IS NOT NULL").select("queue_id", "entry_id", U.parse(F.col("u")).alias("p"))
    return R.seen_set(q, "queue_id", U.url_hash(F.col("p")), "entry_id").select("queue_id", "entry_id")


def prefix_scan(spark, d):
    return R.prefix_scan(_fetches(spark, d).select("request_id", F.coalesce("page_size", F.lit(0)).cast("bigint").alias("page_size")), "page_size", "request_id", "upto").select("request_id", "upto")


def crawl_status_totals(spark, d):
    return C.status_totals(_fetches(spark, d), ["queue_id"], "page_size", "crawled_time")


def consecutive_errors(spark, d):
    return R.consecutive_errors(_fetches(spark, d), "queue_id", ["crawled_time", "request_id"], F.col("error_code") < 0)


def hourly_status(spark, d):
    return jobs.windowed_status(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", group="event_type").select(F.col("start").cast("string").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _addresses(spark, d):
    return table(spark, d, "queue_info").select(F.col("queue_id").alias("hid"), F.explode("site_ips").alias("ipaddr"))


def first_ip(spark, d):
    return C.first_addresses(table(spark, d, "queue_info").select(F.col("queue_id").alias("hid")), _addresses(spark, d))


def next_site(spark, d):
    q = first_ip(spark, d).join(table(spark, d, "queue_info").select(F.col("queue_id").alias("hid"), "success_count"), "hid")
    return C.next_site(q.filter("success_count % 2 = 0"), q.filter("success_count % 2 <> 0"))


def claim_site(spark, d):
    """The crawling table after the next site was claimed by crawler 7."""
    q = first_ip(spark, d).join(table(spark, d, "queue_info").select(F.col("queue_id").alias("hid"), "success_count"), "hid")
    crawling = q.filter("success_count % 2 <> 0").select("hid", F.lit(1).alias("id"), "ipaddr")
    return C.claim(q.filter("success_count % 2 = 0").select("hid", "ipaddr"), crawling, 7)[1]


def alias_merge(spark, d):
    q = table(spark, d, "queue_info")
    names = q.select("queue_id", F.posexplode("site_names").alias("k", "host")).select("host", (F.col("queue_id") * 10 + F.col("k")).alias("pos"))
    ips = q.select(F.explode("site_names").alias("host"), "site_ips").select("host", F.explode("site_ips").alias("ipaddr"))
    return C.alias_merge(names, ips)


def alias_prune(spark, d):
    q = table(spark, d, "queue_info")
    names = q.select(F.explode("site_names").alias("host"), F.col("site_names")[0].alias("head"), "delay")
    robots = names.select("host", F.when(~F.col("host").startswith("mirror."), F.concat(F.lit("Crawl-delay: "), F.col("delay"))).alias("robots"))
    return C.alias_prune(names.select("host", "head"), robots)


def host_lookup(spark, d):
    """Host parameters with the aliases of each host."""
    a = table(spark, d, "aliases").filter("hid IS NOT NULL").groupBy("hid").agg(F.count_distinct("alias").alias("n_aliases"))
    return table(spark, d, "hosts").select("hid", "hostname", "maxpages", "minpause").join(a, "hid", "left").select("hid", "hostname", "maxpages", "minpause", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))


def stop_reasons(spark, d):
    q = table(spark, d, "queue_info")
    return q.select("queue_id", C.stop_reason(F.col("error_count"), F.col("success_count"), F.coalesce("consecutive_errors", F.lit(0)), F.lit(0), F.col("success_count")).alias("reason"))


def crawl_simulation(spark, d):
    """What a crawl from the site roots reaches inside each site, by level."""
    site = table(spark, d, "responses").filter("docid IS NOT NULL AND queue_id IS NOT NULL").groupBy(F.col("docid").alias("id")).agg(F.min("queue_id").alias("site"))
    roots = table(spark, d, "queue_info").select(F.col("root_docid").alias("id"), F.col("queue_id").alias("site")).filter("id IS NOT NULL")
    site = site.join(roots.select("id"), "id", "left_anti").unionByName(roots)
    e = table(spark, d, "edges").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")
    return C.simulate(e, roots, site).groupBy("site", "level").agg(F.count(F.lit(1)).alias("n"))


def politeness(spark, d):
    q = table(spark, d, "url_queue").filter("u IS NOT NULL")
    return C.politeness(q, "queue_id", ["seed_level", "entry_id"]).select("queue_id", "entry_id", F.col("due_s").cast("bigint").alias("due_s"))


def conjunctive_search(spark, d):
    return R.search(table(spark, d, "documents"), "doc_id", "text", "source", QUERY).select("doc_id", "title_match")


def title_rank(spark, d):
    """Pages that hold both words, those with one in the title first."""
    p = _pages(spark, d).filter("page IS NOT NULL").select("request_id", H.plain_text(F.col("page")).alias("words"), F.regexp_extract("page", "(?is)<title>(.*?)</title>", 1).alias("title"))
    return R.search(p, "request_id", "words", "title", "link tables").select("request_id", "title_match")


def page_sizes_by_day(spark, d):
    """Bytes and pages of 8 January."""
    return _fetches(spark, d).filter("month(crawled_time) = 1 AND day(crawled_time) = 8").agg(F.coalesce(F.sum("page_size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("pages"))


def site_pages(spark, d):
    return _fetches(spark, d).groupBy("queue_id").agg(F.count(F.lit(1)).alias("num_pages"), F.count_if("stored").alias("stored_pages"))


def file_groups(spark, d):
    """Sites grouped by device number, as files are shared out to workers."""
    return table(spark, d, "queue_info").groupBy((F.col("queue_id") % 4).alias("device")).agg(F.sort_array(F.collect_list("queue_id")).alias("sites"))


def bulk_load(spark, d):
    """One address for each document id."""
    p = table(spark, d, "responses").filter("docid IS NOT NULL AND page_url IS NOT NULL")
    return p.groupBy("docid").agg(F.min("page_url").alias("url"))


def dump_urls(spark, d):
    """Addresses of the store from an offset on, at most so many: the dump tool's own arguments."""
    return _fetches(spark, d).filter("request_id >= 20").orderBy("request_id").limit(50).select("request_id", "page_url")


def uncrawled_hosts(spark, d):
    """Hosts without any alias."""
    return table(spark, d, "hosts").join(table(spark, d, "aliases").select("hid"), "hid", "left_anti").select("hid", "hostname")


def ending_links(spark, d):
    """Pages with a link to an address of one ending, and those links."""
    l = H.page_links(_pages(spark, d), "request_id", "page_url", "page").select("request_id", "target", U.parse(F.col("target")).alias("p"))
    return l.filter(U.extension(F.col("p.path")) == "html").select("request_id", "target").distinct()


def put_aside(spark, d):
    """URLs by host, and port where it isn't 80."""
    p = table(spark, d, "url_queue").filter("u IS NOT NULL").select(U.parse(F.col("u")).alias("p"))
    place = F.concat("p.net_loc", F.when(~F.col("p.port").isin("", "80"), F.concat(F.lit(":"), F.col("p.port"))).otherwise(F.lit("")))
    return p.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def alias_totals(spark, d):
    return R.merge_entries(table(spark, d, "aliases").select("hid", F.lit(1).alias("n")), "hid", "n")


def pair_sort(spark, d):
    return R.sorted_pairs(table(spark, d, "edges").select("from_id", "to_id").filter("from_id IS NOT NULL AND to_id IS NOT NULL"), "from_id", "to_id")


def throughput(spark, d):
    return R.throughput(_fetches(spark, d), "crawled_time", "page_size").select(F.col("start").cast("string").alias("start"), "total", "change")


def stream_diff(spark, d):
    """Where the load order of the aliases differs from their order by number, by host."""
    a = table(spark, d, "aliases").filter("alias_id % 2 = 0")
    b = table(spark, d, "aliases").filter("alias_id % 2 <> 0")
    return R.compare_streams(a, b, "alias_id", "hid")


def site_numbers(spark, d):
    """Largest, smallest and total figures over all sites: the scalar reductions."""
    return table(spark, d, "queue_info").agg(F.min("delay").alias("min_delay"), F.max("delay").alias("max_delay"), F.sum("success_count").alias("success"), F.bool_and(F.col("status") >= 0).alias("all_known"), F.bool_or(F.col("status") > 0).alias("any_busy"))


QUERIES = {
    f.__name__: f
    for f in (
        url_parse, url_canonical, ext_type, url_fields, url_filter_code, url_hashes, reverse_host, id_forms, links_extract, links_resolved, followed_inside, html_plain, html_inline, html_entities, robots_rules,
        host_counts, fwd_links, fwd_links_256, back_links, list_offsets, list_fetch, host_words, valid_ids, link_lookup, sort_unique_merge, dedupe_consecutive, seen_set, prefix_scan, crawl_status_totals, consecutive_errors,
        hourly_status, first_ip, next_site, claim_site, alias_merge, alias_prune, host_lookup, stop_reasons, crawl_simulation, politeness, conjunctive_search, title_rank, page_sizes_by_day, site_pages,
        file_groups, bulk_load, dump_urls, uncrawled_hosts, ending_links, put_aside, alias_totals, pair_sort, throughput, stream_diff, site_numbers,
    )
}

ONE = "(SELECT DISTINCT ON (request_id) * FROM responses)"


def _parse_sql(rows: str, key: str, url: str) -> str:
    """CTEs p1..p4 and ``p``: the parts of ``url`` for each ``key`` of ``rows``."""
    return f"""p1 AS (SELECT {key}, regexp_replace({url}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS u FROM {rows} WHERE {url} IS NOT NULL),
p2 AS (SELECT {key}, regexp_extract(u, '(?s)^[^#]*#(.*)$', 1) AS fragment, regexp_extract(u, '(?s)^([^#]*)', 1) AS u1 FROM p1),
p3 AS (SELECT {key}, fragment, regexp_extract(u1, '(?s)^([A-Za-z0-9+.\\-]*):', 1) AS scheme, regexp_replace(u1, '(?s)^[A-Za-z0-9+.\\-]*:', '') AS u2 FROM p2),
p4 AS (SELECT {key}, fragment, scheme, regexp_extract(u2, '(?s)^//([^/?]*)', 1) AS authority, regexp_replace(u2, '(?s)^//[^/?]*', '') AS u3 FROM p3),
p5 AS (SELECT {key}, fragment, scheme, regexp_replace(lower(regexp_extract(authority, '(?s)^([^:]*)', 1)), '\\.$', '') AS net_loc, regexp_extract(authority, '(?s):(.*)$', 1) AS port,
  regexp_extract(u3, '(?s)^[^?]*\\?(.*)$', 1) AS query, regexp_extract(u3, '(?s)^([^?]*)', 1) AS u4 FROM p4),
p AS (SELECT {key}, scheme, net_loc, port, CASE WHEN regexp_extract(u4, '(?s)^([^;]*)', 1) = '' AND net_loc <> '' THEN '/' ELSE regexp_extract(u4, '(?s)^([^;]*)', 1) END AS path,
  regexp_extract(u4, '(?s)^[^;]*;(.*)$', 1) AS param, query, fragment FROM p5),
c AS (SELECT {key}, (CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END) || (CASE WHEN net_loc <> '' THEN '//' || net_loc || (CASE WHEN port NOT IN ('', '80') THEN ':' || port ELSE '' END) ELSE '' END) || path
  || (CASE WHEN param <> '' THEN ';' || param ELSE '' END) || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS url FROM p)"""


QP = "WITH " + _parse_sql("url_queue", "entry_id", "u")
KIND = """CASE WHEN ext = '' THEN 'text' """ + " ".join(f"WHEN ext IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in U.TYPES.items()) + " ELSE 'unknown' END"
EXT = "lower(regexp_extract(path, '\\.([^./]{2,6})$', 1))"
TAGS = """t AS (SELECT request_id, unnest(regexp_extract_all(page, '(?s)<([^>]*)>', 1)) AS body, unnest(range(len(regexp_extract_all(page, '(?s)<([^>]*)>', 1)))) AS pos FROM {one} WHERE page IS NOT NULL),
l AS (SELECT request_id, CAST(pos AS INTEGER) AS pos, lower(regexp_extract(body, '^([A-Za-z]+)\\s', 1)) AS tag, replace(regexp_replace(regexp_extract(body, '(?is)href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), '&amp;', '&') AS link FROM t WHERE length(body) >= 8)""".replace("{one}", ONE)
TARGETS = "WITH " + _parse_sql(ONE, "request_id", "page_url") + ", " + TAGS + """,
b AS (SELECT p.*, regexp_replace(path, '[^/]*$', '') AS folder, (CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END) || (CASE WHEN net_loc <> '' THEN '//' || net_loc || (CASE WHEN port NOT IN ('', '80') THEN ':' || port ELSE '' END) ELSE '' END) AS place FROM p),
r AS (SELECT l.request_id, l.pos, l.link, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN regexp_replace(link, '^([a-z]+://[^/]*)$', '\\1/')
  WHEN link LIKE '#%' THEN (SELECT url FROM c WHERE c.request_id = l.request_id) WHEN link LIKE '/%' THEN place || regexp_replace(link, '#.*$', '') END AS target
  FROM l JOIN b USING (request_id) WHERE tag IN ('a', 'area', 'link', 'frame', 'iframe') AND link <> '')"""
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<!-.*?->|<[^>]*>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '&(?:[A-Za-z]+|#[0-9]+);', ' ', 'g'), '[^0-9A-Za-z\\[\\]^_`{{|}}~\\x7f]+', ' ', 'g'))"
IPS = "SELECT queue_id AS hid, unnest(site_ips) AS ipaddr FROM queue_info"
IPNUM = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(ipaddr, '.'), lambda x: x::BIGINT)), lambda a, x: a * 256 + x)"
FIRST_IP = f"SELECT q.queue_id AS hid, (SELECT arg_min(ipaddr, {IPNUM}) FROM ({IPS}) i WHERE i.hid = q.queue_id) AS ipaddr, success_count FROM queue_info q"
LISTS = "SELECT from_id AS src, count(DISTINCT to_id) AS n, list_sort(list(DISTINCT to_id)) AS dests FROM edges WHERE from_id <> 0 AND to_id <> 0 GROUP BY from_id"
NAMES = "SELECT queue_id, unnest(site_names) AS host, unnest(range(len(site_names))) AS k FROM queue_info"
BUCKET = "CAST(({x} >> 58) & 63 AS INTEGER)"
HAS = lambda text, words: " AND ".join(f"list_contains(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+'), '{w}')" for w in words)
ANY = lambda text, words: "(" + " OR ".join(f"list_contains(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+'), '{w}')" for w in words) + ")"

SQL = {
    "url_parse": QP + " SELECT entry_id, scheme, net_loc, port, path, param, query, fragment FROM p",
    "url_canonical": QP + " SELECT entry_id, url FROM c",
    "ext_type": QP + f", x AS (SELECT entry_id, {EXT} AS ext FROM p) SELECT entry_id, ext, {KIND} AS kind FROM x",
    "url_fields": QP + """, f AS (SELECT entry_id, unnest(regexp_split_to_array(query, '[&;]')) AS x, unnest(range(len(regexp_split_to_array(query, '[&;]')))) AS k FROM p)
SELECT entry_id, string_split(x, '=')[1] AS name, arg_max(CASE WHEN contains(x, '=') THEN regexp_extract(x, '(?s)=(.*)$', 1) ELSE '' END, k) AS value FROM f WHERE x <> '' GROUP BY ALL""",
    "url_filter_code": QP + f""", x AS (SELECT p.*, {EXT} AS ext, path || (CASE WHEN param <> '' THEN ';' || param ELSE '' END) || (CASE WHEN query <> '' THEN '?' || query ELSE '' END) AS rest FROM p)
SELECT q.entry_id, CASE WHEN {KIND} <> 'text' THEN 1 WHEN starts_with(rest, '/cgi') OR starts_with(rest, '/z') THEN 2 WHEN contains(rest, 'sid=') OR contains(rest, 'calendar') THEN 3
WHEN coalesce(seed_level, 0) > 4 THEN 4 WHEN seed_id >= 5 THEN 5 ELSE 0 END AS code FROM x JOIN url_queue q USING (entry_id)""",
    "reverse_host": "SELECT hid, array_to_string(list_reverse(string_split(hostname, '.')), '.') AS reversed, '/pages/' || array_to_string(list_transform(list_reverse(string_split(hostname, '.')), lambda x: CASE WHEN x = '' THEN '_dot_' ELSE x END), '/') || '/_repository_/text' AS folder FROM hosts WHERE hostname IS NOT NULL",
    "id_forms": f"SELECT rec_id, {BUCKET.format(x='ha_hv')} AS bucket, ha_hv & -2 AS even, lpad(CAST(CASE WHEN ha_hv < 0 THEN ha_hv::HUGEINT + 18446744073709551616::HUGEINT ELSE ha_hv::HUGEINT END AS VARCHAR), 20, '0') AS unsigned FROM hash_log WHERE ha_hv IS NOT NULL",
    "links_extract": "WITH " + TAGS + " SELECT request_id, pos, tag, link FROM l WHERE tag IN ('a', 'area', 'link', 'base') AND link <> ''",
    "links_resolved": TARGETS + " SELECT request_id, pos, link, target FROM r WHERE lower(string_split(target, ':')[1]) = 'http'",
    "host_counts": TARGETS + " SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(target, '^[A-Za-z]+://([^/:?]*)', 1)) AS host FROM r WHERE lower(string_split(target, ':')[1]) = 'http') GROUP BY host",
    "html_plain": f"SELECT request_id, {PLAIN.format(x='page')} AS words, CAST(length(replace({PLAIN.format(x='page')}, ' ', '')) AS INTEGER) AS letters FROM {ONE} WHERE page IS NOT NULL",
    "html_inline": f"""SELECT request_id, {PLAIN.format(x="regexp_replace(page, '(?is)</?(?:" + H.INLINE.replace(' ', '|') + ")(?:[ \\t\\n\\f\\r\\x0B][^>]*)?>', '', 'g')")} AS words FROM {ONE} WHERE page IS NOT NULL""",
    "fwd_links": f"SELECT src, CAST(n AS INTEGER) AS n, dests FROM ({LISTS})",
    "fwd_links_256": f"SELECT src, CAST(n AS INTEGER) AS n, dests FROM ({LISTS}) WHERE n <= 256",
    "back_links": f"SELECT {BUCKET.format(x='to_id')} AS bucket, to_id AS src, from_id AS dst FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL",
    "list_offsets": f"SELECT src, bucket, CAST(coalesce(sum(bytes) OVER (PARTITION BY bucket ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT src, {BUCKET.format(x='src')} AS bucket, 16 + 8 * n AS bytes FROM ({LISTS}))",
    "list_fetch": f"SELECT src, CAST(n AS INTEGER) AS n, dests FROM ({LISTS}) WHERE src IN (SELECT root_docid FROM queue_info)",
    "host_words": "SELECT hid, translate(hostname, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower, regexp_split_to_array(hostname, '[./]') AS fields, list_filter(regexp_split_to_array(hostname, '[./]'), lambda x: x <> '') AS words FROM hosts WHERE hostname IS NOT NULL",
    "valid_ids": "SELECT edge_id FROM edges WHERE (from_id > 10000 OR from_id < 0) AND (to_id > 10000 OR to_id < 0)",
    "link_lookup": "SELECT DISTINCT queue_id, from_id, url FROM edges JOIN queue_info ON to_id = root_docid JOIN (SELECT docid, min(page_url) AS url FROM responses WHERE page_url IS NOT NULL GROUP BY docid) ON from_id = docid",
    "sort_unique_merge": "SELECT DISTINCT from_id, to_id FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL",
    "dedupe_consecutive": "SELECT queue_id, entry_id FROM (SELECT queue_id, entry_id, u, lag(u) OVER (PARTITION BY queue_id ORDER BY entry_id) AS b FROM url_queue WHERE u IS NOT NULL) WHERE b IS NULL OR b <> u",
    "seen_set": QP + " SELECT queue_id, min(entry_id) AS entry_id FROM p JOIN url_queue USING (entry_id) GROUP BY queue_id, p.port || p.path || p.param || p.query",
    "prefix_scan": f"SELECT request_id, CAST(sum(coalesce(page_size, 0)) OVER (ORDER BY request_id) AS BIGINT) AS upto FROM {ONE}",
    "crawl_status_totals": f"""SELECT queue_id, pages, bytes, us, CASE WHEN us > 0 THEN round(bytes * 1e6 / us, 6) END AS bytes_per_s, CASE WHEN us > 0 THEN round(pages * 1e6 / us, 6) END AS pages_per_s FROM (
SELECT queue_id, count(*) AS pages, CAST(coalesce(sum(page_size), 0) AS BIGINT) AS bytes, epoch_us(max(crawled_time)) - epoch_us(min(crawled_time)) AS us FROM {ONE} GROUP BY queue_id)""",
    "consecutive_errors": f"""WITH f AS (SELECT queue_id, crawled_time, request_id, CAST(error_code < 0 AS INTEGER) AS f FROM {ONE}), o AS (SELECT *, sum(1 - f) OVER (PARTITION BY queue_id ORDER BY crawled_time, request_id) AS ok FROM f),
r AS (SELECT queue_id, ok, sum(f) AS run, count(*) AS n FROM o GROUP BY ALL) SELECT queue_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) - sum(run) AS BIGINT) AS n_success, CAST(sum(run) AS BIGINT) AS n_error, CAST(max(run) AS BIGINT) AS longest_error_run FROM r GROUP BY queue_id""",
    "hourly_status": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('hour', ts), event_type",
    "first_ip": f"SELECT hid, ipaddr FROM ({FIRST_IP})",
    "next_site": f"WITH q AS ({FIRST_IP}) SELECT hid, ipaddr FROM q WHERE success_count % 2 = 0 AND ipaddr NOT IN (SELECT ipaddr FROM q WHERE success_count % 2 <> 0) ORDER BY hid LIMIT 1",
    "claim_site": f"WITH q AS ({FIRST_IP}) SELECT hid, 1 AS id, ipaddr FROM q WHERE success_count % 2 <> 0 UNION ALL (SELECT hid, 7, ipaddr FROM q WHERE success_count % 2 = 0 AND ipaddr NOT IN (SELECT ipaddr FROM q WHERE success_count % 2 <> 0) ORDER BY hid LIMIT 1)",
    "alias_merge": f"""WITH n AS (SELECT host, queue_id * 10 + k AS pos, (SELECT min(i) FROM (SELECT unnest(site_ips) AS i FROM queue_info q WHERE q.queue_id = x.queue_id)) AS ip, CASE WHEN host LIKE 'www.%' THEN substr(host, 5) ELSE 'www.' || host END AS twin FROM ({NAMES}) x)
SELECT a.host, CASE WHEN b.pos < a.pos AND a.ip = b.ip THEN b.host ELSE a.host END AS head FROM n a LEFT JOIN n b ON a.twin = b.host""",
    "alias_prune": "SELECT host, head FROM (SELECT unnest(site_names) AS host, site_names[1] AS head FROM queue_info) WHERE starts_with(host, 'mirror.') = starts_with(head, 'mirror.')",
    "host_lookup": "SELECT hid, hostname, maxpages, minpause, coalesce(n, 0) AS n_aliases FROM hosts LEFT JOIN (SELECT hid, count(DISTINCT alias) AS n FROM aliases WHERE hid IS NOT NULL GROUP BY hid) USING (hid)",
    "stop_reasons": "SELECT queue_id, CASE WHEN error_count + success_count >= 10 AND (error_count > success_count OR coalesce(consecutive_errors, 0) >= 5) THEN 'Too many Errors' WHEN success_count >= 20000 THEN 'Max Count' ELSE 'Done' END AS reason FROM queue_info",
    "crawl_simulation": """WITH RECURSIVE s0 AS (SELECT docid AS id, min(queue_id) AS site FROM responses WHERE docid IS NOT NULL AND queue_id IS NOT NULL GROUP BY docid),
s AS MATERIALIZED (SELECT * FROM s0 WHERE id NOT IN (SELECT root_docid FROM queue_info WHERE root_docid IS NOT NULL) UNION ALL SELECT root_docid, queue_id FROM queue_info WHERE root_docid IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges JOIN s a ON from_id = a.id JOIN s b ON to_id = b.id WHERE a.site = b.site),
r(id, site, level) AS (SELECT root_docid, queue_id, 0 FROM queue_info WHERE root_docid IS NOT NULL UNION SELECT e.dst, r.site, r.level + 1 FROM r JOIN e ON r.id = e.src WHERE r.level < 10),
l AS (SELECT id, site, min(level) AS level FROM r GROUP BY id, site) SELECT site, level, count(*) AS n FROM l GROUP BY site, level""",
    "politeness": "SELECT queue_id, entry_id, (row_number() OVER (PARTITION BY queue_id ORDER BY seed_level NULLS FIRST, entry_id) - 1) * 10 AS due_s FROM url_queue WHERE u IS NOT NULL",
    "conjunctive_search": f"SELECT doc_id, {ANY('coalesce(source, chr(0))', ['link', 'pages'])} AS title_match FROM documents WHERE text IS NOT NULL AND {HAS('text', ['link', 'pages'])}",
    "title_rank": f"""SELECT request_id, {ANY("regexp_extract(page, '(?is)<title>(.*?)</title>', 1)", ['link', 'tables'])} AS title_match FROM {ONE} WHERE page IS NOT NULL AND {HAS(PLAIN.format(x='page'), ['link', 'tables'])}""",
    "page_sizes_by_day": f"SELECT CAST(coalesce(sum(page_size), 0) AS BIGINT) AS bytes, count(*) AS pages FROM {ONE} WHERE month(crawled_time) = 1 AND day(crawled_time) = 8",
    "site_pages": f"SELECT queue_id, count(*) AS num_pages, count(page) AS stored_pages FROM {ONE} GROUP BY queue_id",
    "file_groups": "SELECT CAST(queue_id % 4 AS INTEGER) AS device, list_sort(list(queue_id)) AS sites FROM queue_info GROUP BY queue_id % 4",
    "bulk_load": "SELECT docid, min(page_url) AS url FROM responses WHERE docid IS NOT NULL AND page_url IS NOT NULL GROUP BY docid",
    "dump_urls": f"SELECT request_id, page_url FROM {ONE} WHERE request_id >= 20 ORDER BY request_id LIMIT 50",
    "uncrawled_hosts": "SELECT hid, hostname FROM hosts WHERE hid NOT IN (SELECT hid FROM aliases WHERE hid IS NOT NULL)",
    "ending_links": TARGETS + " SELECT DISTINCT request_id, target FROM r WHERE lower(string_split(target, ':')[1]) = 'http' AND regexp_matches(target, '(?i)^[^?#;]*/[^/?#;]*\\.html([?#;]|$)')",
    "put_aside": QP + " SELECT net_loc || (CASE WHEN port NOT IN ('', '80') THEN ':' || port ELSE '' END) AS place, count(*) AS n FROM p GROUP BY ALL",
    "alias_totals": "SELECT hid, count(*) AS n FROM aliases WHERE hid IS NOT NULL GROUP BY hid",
    "pair_sort": "SELECT from_id, to_id FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL",
    "throughput": f"WITH s AS (SELECT date_trunc('hour', crawled_time) AS t, CAST(coalesce(sum(page_size), 0) AS BIGINT) AS total FROM {ONE} WHERE crawled_time IS NOT NULL GROUP BY ALL) SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS start, total, total - lag(total) OVER (ORDER BY t) AS change FROM s",
    "stream_diff": """WITH a AS (SELECT row_number() OVER (ORDER BY alias_id) AS pos, hid AS a FROM aliases WHERE alias_id % 2 = 0), b AS (SELECT row_number() OVER (ORDER BY alias_id) AS pos, hid AS b FROM aliases WHERE alias_id % 2 <> 0)
SELECT pos, a, b FROM a FULL JOIN b USING (pos) WHERE a IS DISTINCT FROM b""",
    "site_numbers": "SELECT min(delay) AS min_delay, max(delay) AS max_delay, CAST(sum(success_count) AS BIGINT) AS success, bool_and(status >= 0) AS all_known, bool_or(status > 0) AS any_busy FROM queue_info",
}
