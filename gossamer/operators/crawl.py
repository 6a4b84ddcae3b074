"""Crawl tables, filters and an offline crawl over stored links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..session import cut

#: Limits of a crawl (fixed values): tries before errors count, errors in a row, seconds between requests.
TRIES, ERRORS_IN_ROW, PAUSE_S = 10, 5, 10
SITE_PAGES, SITE_DEPTH, SITE_PAUSE_MS = 20_000, 10, 10_000


def filter_code(parsed: Column, level: Column, count: Column, prefixes: list[str], substrings: list[str], types: list[str], max_level: int, max_count: int) -> Column:
    """Why a URL is refused: 1 type, 2 prefix, 3 substring, 4 level, 5 count; 0 if it passes."""
    kind = U.file_type(parsed["path"])
    rest = F.concat(parsed["path"], F.when(parsed["param"] != "", F.concat(F.lit(";"), parsed["param"])).otherwise(F.lit("")), F.when(parsed["query"] != "", F.concat(F.lit("?"), parsed["query"])).otherwise(F.lit("")))
    hit = lambda test, words: F.coalesce(F.greatest(*[test(w) for w in words], F.lit(False)), F.lit(False)) if words else F.lit(False)
    typed = F.lit(True) if "any" in types else kind.isin(types)
    return (
        F.when(~typed, 1)
        .when(hit(lambda w: rest.startswith(w), prefixes), 2)
        .when(hit(lambda w: rest.contains(w), substrings), 3)
        .when(level > max_level, 4)
        .when(count >= max_count, 5)
        .otherwise(0)
    )


def same_server(host: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.lower(n) == F.lower(host))


def first_addresses(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """``hid`` and its smallest address by number, null where a host has none."""
    number = F.aggregate(F.split("ipaddr", r"\."), F.lit(0).cast("bigint"), lambda a, x: a * 256 + F.coalesce(x.cast("bigint"), F.lit(0)))
    low = addresses.withColumn("_n", number).groupBy("hid").agg(F.min_by("ipaddr", F.struct("_n", "ipaddr")).alias("ipaddr"))
    return hosts.select("hid").join(low, "hid", "left")


def next_site(uncrawled: DataFrame, crawling: DataFrame) -> DataFrame:
    """The uncrawled host of smallest hid whose address isn't being crawled."""
    return uncrawled.join(crawling.select("ipaddr"), "ipaddr", "left_anti").orderBy("hid").limit(1).select("hid", "ipaddr")


def move(source: DataFrame, target: DataFrame, ids: DataFrame, key: str = "hid") -> tuple[DataFrame, DataFrame]:
    """Rows of the given ids taken from one table and put into another, as new tables."""
    taken = source.join(ids.select(key), key, "left_semi")
    return source.join(ids.select(key), key, "left_anti"), target.unionByName(taken, allowMissingColumns=True)


def claim(uncrawled: DataFrame, crawling: DataFrame, crawler: int) -> tuple[DataFrame, DataFrame]:
    """The next site moved to the crawling table under a crawler's id."""
    site = next_site(uncrawled, crawling)
    left, _ = move(uncrawled, crawling, site)
    return left, crawling.unionByName(site.select("hid", F.lit(crawler).alias("id"), "ipaddr"), allowMissingColumns=True)


def alias_merge(sites: DataFrame, addresses: DataFrame) -> DataFrame:
    """``host``, ``head``: a host joins its ``www.`` twin when their smallest addresses agree; the twin of
    better (smaller) ``pos`` is the head."""
    low = addresses.groupBy("host").agg(F.min("ipaddr").alias("ip"))
    known = sites.join(low, "host", "left")
    twin = F.when(F.col("host").startswith("www."), F.substring("host", 5, 10_000)).otherwise(F.concat(F.lit("www."), F.col("host")))
    other = known.select(F.col("host").alias("_twin"), F.col("pos").alias("_pos"), F.col("ip").alias("_ip"))
    joined = known.withColumn("_twin", twin).join(other, "_twin", "left")
    agree = F.col("ip").isNotNull() & (F.col("ip") == F.col("_ip"))
    return joined.select("host", F.when(agree & (F.col("_pos") < F.col("pos")), F.col("_twin")).otherwise(F.col("host")).alias("head"))


def alias_prune(aliases: DataFrame, robots: DataFrame) -> DataFrame:
    """Aliases whose robots text equals their head's; a missing text counts as ``0``."""
    digest = lambda c: F.coalesce(F.md5(c), F.lit("0"))
    r = robots.select("host", "robots")
    a = aliases.join(r, "host", "left").withColumn("_a", digest(F.col("robots"))).drop("robots")
    h = r.select(F.col("host").alias("head"), F.col("robots").alias("_hr"))
    return a.join(h, "head", "left").filter(F.col("_a") == digest(F.col("_hr"))).select("host", "head")


def status_totals(fetches: DataFrame, group: list[str], size: str, time: str) -> DataFrame:
    """Pages, bytes, seconds between first and last fetch, and their rates; no rate for no time."""
    t = fetches.groupBy(*group).agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), (F.max(F.unix_micros(F.col(time).cast("timestamp"))) - F.min(F.unix_micros(F.col(time).cast("timestamp")))).alias("us"))
    rate = lambda c: F.when(F.col("us") > 0, F.round(F.col(c) * 1e6 / F.col("us"), 6))
    return t.select(*group, "pages", "bytes", "us", rate("bytes").alias("bytes_per_s"), rate("pages").alias("pages_per_s"))


def stop_reason(errors: Column, successes: Column, in_row: Column, level: Column, count: Column) -> Column:
    """How a site's crawl ended."""
    tries = errors + successes
    return F.when((tries >= TRIES) & ((errors > successes) | (in_row >= ERRORS_IN_ROW)), "Too many Errors").when(count >= SITE_PAGES, "Max Count").when(level >= SITE_DEPTH, "Max Level").otherwise("Done")


def seed_table(hosts: DataFrame) -> DataFrame:
    """Hosts with the default limits of a crawl."""
    return hosts.select("hid", "hostname", F.lit(SITE_PAGES).alias("maxpages"), F.lit(SITE_DEPTH).alias("maxdepth"), F.lit(SITE_PAUSE_MS).alias("minpause"))


def politeness(frontier: DataFrame, site: str, order: list[str], pause_s: float = PAUSE_S) -> DataFrame:
    """The earliest second each URL of a site may be asked for."""
    return frontier.withColumn("due_s", (F.row_number().over(Window.partitionBy(site).orderBy(*order)) - 1) * F.lit(pause_s))


def simulate(links: DataFrame, seeds: DataFrame, site_of: DataFrame, depth: int = SITE_DEPTH, pages: int = SITE_PAGES) -> DataFrame:
    """An offline crawl over stored links: ``id``, ``site``, ``level`` of what would be fetched.

    ``links`` (src, dst), ``seeds`` (id), ``site_of`` (id, site).  Level by level, only inside the seeds'
    sites, at most ``pages`` a site in order of level and id: the crawl's own limit, not a shortcut.
    """
    inner = links.join(site_of.withColumnsRenamed({"id": "src", "site": "s1"}), "src").join(site_of.withColumnsRenamed({"id": "dst", "site": "s2"}), "dst").filter("s1 = s2").select("src", "dst").distinct()
    inner = cut(inner)
    front = cut(seeds.select("id").distinct().join(site_of, "id").select("id", "site", F.lit(0).alias("level")))
    seen = front
    for level in range(1, depth + 1):
        step = inner.join(front.select(F.col("id").alias("src"), "site"), "src").select(F.col("dst").alias("id"), "site", F.lit(level).alias("level")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("level", "id"))
    return seen.withColumn("_r", rank).filter(F.col("_r") <= pages).drop("_r")


def finished_sites(log: DataFrame, line: str) -> DataFrame:
    """Sites named by ``SiteDone:`` lines of a crawl log."""
    return log.select(F.regexp_extract(line, r"SiteDone:\s*(\S+)", 1).alias("host")).filter("host <> ''").distinct()


def save_queue(state: dict[str, DataFrame], path: str) -> None:
    """Write the parts of a crawl's state (frontier, seen hashes, counters, filters ...) as one folder each; a
    state saved before is replaced."""
    for name, part in state.items():
        part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_queue(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The parts of a saved state."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def take_turns(frontier: DataFrame, site: str, order: list[str], counters: DataFrame, pending: int = 2) -> DataFrame:
    """The next URLs to ask for: each site in turn gives its oldest ones, at most ``pending`` a site less what it
    waits for, and none once its errors end its crawl.

    ``counters``: one row a site with ``waiting``, ``errors``, ``successes``, ``in_row``.  Sites without
    counters have none of either.  ``turn`` numbers the round in which a URL is given out.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    open_ = stop_reason(zero("errors"), zero("successes"), zero("in_row"), F.lit(0), zero("successes")) == "Done"
    sites = frontier.select(site).distinct().join(counters, site, "left").filter(open_).select(site, (F.lit(pending) - zero("waiting")).alias("_free")).filter("_free > 0")
    # minima leave each task before the shuffle: no window sees a whole site
    row = F.struct(*order, *[c for c in frontier.columns if c not in order])
    first = _smallest(frontier, site, row, pending)
    given = first.join(sites, site).select(site, "_free", F.posexplode("_rows").alias("turn", "_row")).filter("turn < _free")
    return given.select("turn", *[F.col(f"_row.{c}").alias(c) for c in frontier.columns])


def _smallest(df: DataFrame, group: str, row: Column, n: int) -> DataFrame:
    """The ``n`` smallest rows of each group, merged pairwise: no list grows beyond ``n``."""
    first = df.groupBy(group).agg(F.min(row).alias("_m"))
    out = first.select(group, F.array("_m").alias("_rows"))
    for _ in range(n - 1):
        nxt = df.withColumn("_row", row).join(out.select(group, F.element_at("_rows", -1).alias("_last")), group).filter(F.col("_row") > F.col("_last")).groupBy(group).agg(F.min("_row").alias("_m"))
        out = out.join(nxt, group, "left").select(group, F.when(F.col("_m").isNull(), F.col("_rows")).otherwise(F.concat("_rows", F.array("_m"))).alias("_rows"))
    return out
