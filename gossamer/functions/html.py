"""HTML, HTTP, robots and string functions as Column expressions."""

from __future__ import annotations

import html.entities
import re
import string

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import url as U

#: Tags whose links are read, with the attribute that holds them (fixed values).
LINK_TAGS = {"a": "href", "area": "href", "link": "href", "base": "href", "frame": "src", "iframe": "src", "img": "src"}
FOLLOWED = ("a", "area", "link", "frame", "iframe")
#: Inline tags that don't part words (fixed values).
INLINE = "a b big em font i s small strike strong sub sup tt u code dfn kbd samp"
MIN_TAG = 8


def tags(page: Column, mode: str = "scanner") -> Column:
    """The tag bodies of a page in order; a tag ends at its first ``>``.

    ``scanner`` reads tags inside comments too, as a scanner without comment handling does; ``clean``
    takes comments out first.
    """
    text = F.regexp_replace(page, r"(?s)<!--.*?-->", "") if mode == "clean" else page
    return F.regexp_extract_all(text, F.lit(r"(?s)<([^>]*)>"), 1)


def links(page: Column, mode: str = "scanner") -> Column:
    """Links of a page: array of (pos, tag, link) in order; ``&amp;`` in a link is read as ``&``."""
    bodies = F.transform(tags(page, mode), lambda b, i: F.struct(i.alias("pos"), F.lower(F.regexp_extract(b, r"^([A-Za-z]+)\s", 1)).alias("tag"), b.alias("body")))
    wanted = F.filter(bodies, lambda t: t["tag"].isin(*LINK_TAGS) & (F.length(t["body"]) >= MIN_TAG))

    def value(t: Column) -> Column:
        attr = lambda name: F.regexp_extract(t["body"], rf"(?is){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        raw = F.when(t["tag"].isin("frame", "iframe", "img"), attr("src")).otherwise(attr("href"))
        return F.replace(F.regexp_replace(raw, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))

    found = F.transform(wanted, lambda t: F.struct(t["pos"].alias("pos"), t["tag"].alias("tag"), value(t).alias("link")))
    return F.filter(found, lambda x: x["link"] != "")


def exploded(values: Column) -> Column:
    """A row for each value, and a null row where there is none.

    The plain form lets the optimizer put a filter of the same expression before it, which would read each
    page twice.
    """
    return F.explode_outer(values)


def page_links(pages: DataFrame, key: str, address: str, page: str, mode: str = "clean", images: bool = False, http_only: bool = True) -> DataFrame:
    """``key``, ``pos``, ``tag``, ``link`` and resolved ``target`` of the followed links of all pages.

    A ``base`` tag changes the base of the links after it.  Only http links are followed by default.
    """
    rows = pages.filter(F.col(page).isNotNull() & F.col(address).isNotNull()).select(key, F.col(address).alias("own"), exploded(links(F.col(page), mode)).alias("l")).filter("l IS NOT NULL").select(key, "own", "l.*")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    based = rows.withColumn("base", F.coalesce(F.last(F.when(F.col("tag") == "base", F.col("link")), True).over(before), F.col("own")))
    followed = based.filter(F.col("tag").isin(*FOLLOWED, *(["img"] if images else [])))
    parsed = followed.select(key, "pos", "tag", "link", U.parse(F.col("link")).alias("r"), U.parse(F.col("base")).alias("b"))
    out = parsed.select(key, "pos", "tag", "link", U.resolve_parts(F.col("link"), F.col("r"), F.col("b")).alias("target"))
    return out.filter(F.lower(F.substring_index("target", ":", 1)) == "http") if http_only else out


def plain_text(page: Column) -> Column:
    """Words of a page joined by single blanks: comments and tags fall away, references are read, then
    everything but letters, digits and ``[ ] ^ _ ` { | } ~`` parts words."""
    text = F.regexp_replace(page, r"(?s)<!-.*?->|<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"&nbsp;|&#160;", " "), r"&(?:[A-Za-z]+|#\d+);", " ")
    return F.trim(F.regexp_replace(text, r"[^0-9A-Za-z\[\]^_`{|}~\x7f]+", " "))


def inline_text(page: Column) -> Column:
    """Plain text in which inline tags don't part words."""
    joined = F.regexp_replace(page, rf"(?is)</?(?:{INLINE.replace(' ', '|')})(?:\s[^>]*)?>", "")
    return plain_text(joined)


def letter_count(page: Column) -> Column:
    """Characters of words outside tags."""
    return F.length(F.replace(plain_text(page), F.lit(" "), F.lit("")))


@F.pandas_udf(T.StringType())
def latin1_entities(texts: pd.Series) -> pd.Series:
    """Character references onto Latin-1: numbers modulo 256, ``trade`` is 153, unknown names a blank."""

    def one(m: re.Match) -> str:
        name = m.group(1)
        if name[0] == "#":
            return chr(int(name[1:]) % 256)
        if name == "trade":
            return "\x99"
        c = html.entities.name2codepoint.get(name, 32)
        return chr(c) if c < 256 else " "

    return texts.map(lambda t: None if t is None else re.sub(r"&(#\d+|[A-Za-z]+\d*);", one, t))


def body_of(response: Column) -> Column:
    """What follows the first empty line."""
    return F.regexp_extract(response, r"(?s)^.*?\r?\n\r?\n(.*)$", 1)


def http_header(response: Column) -> Column:
    """The header, if the response begins with one, else empty."""
    return F.regexp_extract(response, r"(?s)^(HTTP/.*?\r?\n\r?\n)", 1)


def response_class(header: Column) -> Column:
    """``store``, ``redirect``, ``error`` or ``unknown`` by the first digit after the first blank."""
    digit = F.regexp_extract(header, r"^\S+ (\d)", 1)
    return F.when(digit == "2", "store").when(digit == "3", "redirect").when(digit.isin("4", "5"), "error").otherwise("unknown")


def location(header: Column) -> Column:
    return F.regexp_extract(header, r"(?im)^Location:\s*(\S+)", 1)


def split_nonempty(text: Column, separators: str) -> Column:
    return F.filter(F.split(text, "[" + re.escape(separators) + "]"), lambda x: x != "")


def split_fields(text: Column, separators: str) -> Column:
    """Fields between separators, empty ones kept: ``:a::b:`` has five."""
    return F.split(text, "[" + re.escape(separators) + "]", -1)


def ascii_lower(text: Column) -> Column:
    """Small letters for the 26 of ASCII only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_lines(text: Column) -> Column:
    """Lines ended by CR, LF or both."""
    return F.split(text, r"\r\n|\r|\n")


def name_value(line: Column) -> Column:
    """``name:value`` with blanks around both taken off, comments after ``#`` cut."""
    clean = F.regexp_extract(line, r"^([^#]*)", 1)
    return F.struct(F.lower(F.trim(F.substring_index(clean, ":", 1))).alias("name"), F.trim(F.regexp_extract(clean, r":(.*)$", 1)).alias("value"))


def robots_rules(robots: DataFrame, site: str, text: str, agent: str) -> DataFrame:
    """``site`` and ``prefix`` forbidden for ``agent``: its own group if there is one, else that of ``*``.

    An empty Disallow forbids nothing.  Consecutive User-agent lines share a group.
    """
    rows = robots.select(site, F.posexplode(text_lines(F.col(text))).alias("pos", "line")).select(site, "pos", name_value(F.col("line")).alias("x")).select(site, "pos", "x.*").filter("name IN ('user-agent', 'disallow')")
    by = Window.partitionBy(site).orderBy("pos")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(by), F.lit("disallow")) != "user-agent")
    grouped = rows.withColumn("grp", F.sum(starts.cast("int")).over(by))
    agents = grouped.filter("name = 'user-agent'").select(site, "grp", F.when(F.lower("value").contains(agent.lower()) & (F.col("value") != "*"), 1).when(F.col("value") == "*", 0).alias("rank")).filter("rank IS NOT NULL")
    best = agents.withColumn("top", F.max("rank").over(Window.partitionBy(site))).filter("rank = top").select(site, "grp").distinct()
    return grouped.filter("name = 'disallow' AND value <> ''").join(best, [site, "grp"], "left_semi").select(site, F.col("value").alias("prefix")).distinct()
