"""Problem 6: the main body of a page, by a site style tree.

The pages of one site are merged into a tree of presentation branches (``div`` with its class, table
cell with its width, ``aside`` ...).  A branch has two entropies, both normalised by its pages: that of its
styles (the sequence of elements in which its texts stand) and that of its contents (1 for text of a
single page, 0 for text that all pages of the site hold).  Branches whose importance is low are removed
from every page, and so are repeated contents inside the branches that stay.  The importance is that of the
contents where these are clearly the page's own (all articles of a site may be built alike), else the mean
of both.

Below a branch stand its leaf elements (``p/em``, ``h1``, ``li/a`` ...).  A leaf that each page shows about
once, always in the same form but for names and numbers (bylines, numbers and dates of the document), is
of low importance too.  Lines in the form of a breadcrumb path or a date, and lines that name the site
beside another name, are leaves of their own, judged by how many pages show them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import lines, spam
from .lines import FURNITURE
from .pages import LETTER

#: Pages of a site that must show a branch before the site's own tree judges it; else all sites' tree does.
MIN_PAGES = 12
#: Importance of contents that are clearly the page's own.
CLEAR = 0.9
#: Entropy of a leaf's forms below which it is always the same, and how often a page may show it.
SAME_FORM, ONCE = 0.2, 1.5
#: Pages that show a leaf of a special form before it may count as furniture.
FORM_PAGES = 4
#: Pages of a branch from which its source judges a special form by itself.
ENOUGH = 50
#: Longest line whose form is looked at.
FORM_CHARS = 80
BRANCH = re.compile(r"<(/?)(main|article|aside|footer|header|nav|section|form|div|td|th|title|script|style|noscript)\b([^>]*)>", re.I)
ATTRIBUTE = re.compile(r"(class|id|width|colspan)\s*=\s*[\"']?([^\"'\s>]+)", re.I)
FIRST_TEXT = re.compile(r"(?:\s+|<[^>\n]*>)*")
OPENED = re.compile(r"<([A-Za-z][\w-]*)")
BODY = re.compile(r"<(?:body|html|!doctype|div|table|p)\b", re.I)
SILENT = ("title", "script", "style", "noscript")
#: Cells inside a content branch are its table rows, no branches.
CELLS = ("td", "th")
NAME = re.compile(r"[A-Z](?:(?<![^\W\d_].)|(?<=[぀-ヿ一-鿿：].))[a-z]+")
NAMES = re.compile(r"(?:\b[A-Z]\. )*N(?: (?:[A-Z]\. )*N)*")
DIGIT = re.compile(r"\d")
CODED = re.compile(r"\w*\d\w*(?:[.\-/:]\w*\d\w*)*")
DATE = re.compile(r"^\W*(?:[^\W\d_]{1,6}\W+)?\w{1,8}\W+\d{4}\W\d\d?\W\d\d?\W*$|^\W*\d{1,4}\W\d\d?\W\d{1,4}\W*$")
STEP = re.compile(r"\s(?:>|&gt;|»|›|/)\s")


@lru_cache(maxsize=4096)
def _element(markup: str) -> tuple[bool, str, str]:
    """Whether a tag closes, its name and its label: the name with class and id, or a cell's attributes."""
    m = BRANCH.match(markup)
    tag = m.group(2).lower()
    found = ATTRIBUTE.findall(m.group(3))
    if tag in CELLS:
        label = "td " + " ".join(sorted(f"{a.lower()}={v}" for a, v in found))
    else:
        label = f"{tag} " + " ".join(v for a, v in found if a.lower() in ("class", "id"))
    return bool(m.group(1)), tag, label.strip()


@lru_cache(maxsize=4096)
def _leaf(markup: str) -> str:
    """The elements opened before the text of a line."""
    return "/".join(x.lower() for x in OPENED.findall(markup))


def branches_of_lines(page: str, wanted: list[bool]) -> list[tuple[str, str]]:
    """The branch and the leaf in which the first text of each wanted line stands."""
    at, names = [0], ["body"]
    stack: list[tuple[str, str]] = []  # tag and the path of branches down to it
    for m in BRANCH.finditer(page):
        closing, tag, label = _element(m.group())
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            above = stack[-1][1] if stack else ""
            if tag in CELLS and above:
                label = ""  # a table row of the content, no cell of the layout
            stack.append((tag, f"{above}/{label}" if above and label else above or label))
        at.append(m.end())
        names.append(stack[-1][1] if stack and stack[-1][1] else "body")
    out, start, k, last = [], 0, 0, len(at) - 1
    for line, ask in zip(page.split("\n"), wanted):
        end = start + len(line)
        while k < last and at[k + 1] <= start:
            k += 1
        if not ask:
            out.append(("", ""))
        else:
            first, leaf = start, ""
            if line[0] == "<" or line[0].isspace():
                m = FIRST_TEXT.match(page, start, end)
                first, leaf = m.end(), _leaf(m.group())
            # else no branch begins or ends inside the line
            name = names[k] if k == last or at[k + 1] > end else names[bisect_right(at, first) - 1]
            out.append((name, leaf))
        start = end + 1
    return out


def text_branches(shown: list[str], counts: list[int]) -> list[tuple[str, str]]:
    """Branches of a page without markup: sections parted by two blank lines or more.

    A section that begins with a repeated line is a side section, unless the page's head stands above it.
    """
    out = ["text"] * len(shown)
    k, n = 0, len(shown)
    while k < n:
        end = k
        blanks = 0
        while end < n and blanks < 2:
            blanks = blanks + 1 if not shown[end] else 0
            end += 1
        groups: list[list[int]] = [[]]
        for i in range(k, end):
            if shown[i]:
                groups[-1].append(i)
            elif groups[-1]:
                groups.append([])
        groups = [g for g in groups if g]
        head = False
        while groups and all(counts[i] or is_path(shown[i]) for i in groups[0]):
            head = True
            groups.pop(0)  # repeated lines go by themselves, paths are judged by the site
        if groups and not head and counts[groups[0][0]]:
            for i in range(k, end):
                out[i] = "text side"
        k = end
    return [(x, "") for x in out]


def is_path(shown: str) -> bool:
    """Whether a line has the form of a breadcrumb path: short steps parted by ``>``."""
    steps = [x.strip() for x in STEP.split(shown)]
    return len(steps) > 2 and all(0 < len(x) < 40 for x in steps[:-1]) and len(steps[-1]) < 120


def form(shown: str, names: frozenset[str] = frozenset()) -> str:
    """A line with its numbers and names masked, but for the given ones."""
    t = CODED.sub("0", shown) if DIGIT.search(shown) else shown
    t = NAME.sub(lambda m: m.group() if m.group() in names else "N", t) if names else NAME.sub("N", t)
    return NAMES.sub("N", t) if "N" in t else t


def special_form(shown: str, names: frozenset[str]) -> str:
    """The form of a line that is a leaf of its own, else empty."""
    if len(shown) <= 2 * FORM_CHARS and is_path(shown):
        return "path"
    if len(shown) > FORM_CHARS:
        return ""
    if DIGIT.search(shown) and DATE.match(shown):
        return "date"
    if not names:
        return ""
    found = NAME.findall(shown)
    own = sum(x in names for x in found)
    return form(shown, names) if own and own < len(found) else ""


@lru_cache(maxsize=4096)
def _silent(branch: str) -> bool:
    return branch == "text side" or any(b.split(" ", 1)[0] in SILENT for b in branch.split("/"))


@lru_cache(maxsize=65536)
def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\t".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


#: What a parse of the pages leaves.  Part 0: a line that may be of the article (``key``, ``no`` its line,
#: ``branch``, ``node`` its leaf).  Part 1: what a task saw of a branch in one style (``pages``, ``weight`` in letters,
#: ``spread``).  Part 2: the same of a leaf in one form (``pages``, ``n`` lines).  Part 3: ``spam.MEASURES``.
#: Part 4: the pages of a source.
PARSED = "part int, key bigint, no int, source int, branch string, node bigint, style bigint, pages bigint, n bigint, weight double, spread double, " + spam.MEASURES
FIELDS = [x.split(" ")[0] for x in PARSED.split(", ")]
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}


KINDS = [TYPES[x.split(" ")[1]] for x in PARSED.split(", ")]


def _batch(part: int, names: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one part; the columns it hasn't are null."""
    own = dict(zip(names, zip(*rows))) if rows else {}
    cols = [pa.array(own[c], t) if c in own else pa.nulls(len(rows), t) for c, t in zip(FIELDS, KINDS)]
    cols[0] = pa.array([part] * len(rows), pa.int32())
    return pa.RecordBatch.from_arrays(cols, FIELDS)


def _sums(styles: dict, forms: dict, sizes: Counter) -> Iterator[pa.RecordBatch]:
    yield _batch(1, ("source", "branch", "style", "pages", "weight", "spread"), [(*k, *v) for k, v in styles.items()])
    yield _batch(2, ("source", "branch", "node", "no", "style", "pages", "n"), [(*k, *v) for k, v in forms.items()])
    yield _batch(4, ("source", "pages"), list(sizes.items()))


LINE, BLOCK = ("key", "no", "source", "branch", "node"), ("key", "no", *spam.NAMES)


def _parse(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """One parse of each page into the rows of ``PARSED``."""
    styles: dict[tuple, list[float]] = {}
    forms: dict[tuple, list[int]] = {}
    sizes: Counter = Counter()
    out: list[tuple] = []
    blocks: list[tuple] = []
    for s, text, key, raw, shown, counts, names in rows:
        s = -2 if s is None else s
        sizes[s] += 1
        places = branches_of_lines(text, [bool(x) for x in raw]) if BODY.search(text) else text_branches(shown, counts)
        here: dict[str, list] = {}
        seen: Counter = Counter()
        for k, (x, n, (branch, leaf)) in enumerate(zip(shown, counts, places)):
            if not x or _silent(branch):
                continue
            got = here.setdefault(branch, [0.0, 0.0, []])
            got[0] += len(x)
            got[2].append(leaf)
            if n:
                got[1] += len(x) * math.log(n)
                continue
            special = special_form(x, names)
            # the site's name beside another one is told by the site, a path or date by its place
            node = _hash(special) if special not in ("", "path", "date") else _hash(branch, leaf, special)
            style = 0 if special else _hash(form(x)) if len(x) <= FORM_CHARS else None  # a long line is like no other
            seen["" if special not in ("", "path", "date") else branch, node, 1 if special else 0, style] += 1
            if LETTER.search(raw[k]):
                out.append((key, k, s, branch, node))
        for branch, (letters, spread, leaves) in here.items():
            v = styles.setdefault((s, branch, _hash(*leaves)), [0, 0.0, 0.0])
            v[0] += 1
            v[1] += letters
            v[2] += spread
        for at, n in seen.items():
            v = forms.setdefault((s, *at), [0, 0])
            v[0] += 1
            v[1] += n
        own = spam.measures([x for x, n in zip(shown, counts) if x and not n], text)
        blocks += [(key, no, *m) for no, m in enumerate(own)]
        if len(out) > 20_000:
            yield _batch(0, LINE, out)
            yield _batch(3, BLOCK, blocks)
            out, blocks = [], []
        if len(styles) + len(forms) > 100_000:
            yield from _sums(styles, forms, sizes)
            styles, forms, sizes = {}, {}, Counter()
    yield _batch(0, LINE, out)
    yield _batch(3, BLOCK, blocks)
    yield from _sums(styles, forms, sizes)


def _entropy(share, total):
    """A summand of an entropy normalised by the number of cases."""
    p = share / total
    return -p * F.log(p) / F.log(F.greatest(total, F.lit(2)))


def style_tree(parts: DataFrame) -> DataFrame:
    """``source``, ``branch`` and ``stays`` of every presentation branch, from the tasks' sums.

    A branch stays if it and the branches around it are important enough: by its site's tree where the
    site shows it on ``MIN_PAGES`` pages, else by the tree of all sites, else by the branch around it.
    """
    by_style = parts.groupBy("source", "branch", "style").agg(*[F.sum(c).alias(c) for c in ("pages", "weight", "spread")])
    by_style = written(by_style, "branch-styles")

    def importance(rows: DataFrame, *by: str) -> DataFrame:
        total = rows.groupBy(*by).agg(F.sum("pages").alias("of"), F.sum("weight").alias("weight"), F.sum("spread").alias("spread")).filter(F.col("of") >= MIN_PAGES)
        styles = rows.groupBy(*by, "style").agg(F.sum("pages").alias("pages")).join(total.select(*by, "of"), list(by)).groupBy(*by).agg(F.sum(_entropy(F.col("pages"), F.col("of"))).alias("styles"))
        contents = F.greatest(F.lit(0.0), 1 - F.col("spread") / (F.col("weight") * F.log(F.col("of"))))
        return total.join(styles, list(by)).select(*by, ((contents >= CLEAR) | ((contents + F.col("styles")) / 2 >= FURNITURE)).alias("good"))

    own = importance(by_style, "source", "branch").withColumnRenamed("branch", "step")
    common = importance(by_style, "branch").withColumnsRenamed({"branch": "step", "good": "common"})
    names = by_style.select("source", "branch").distinct()
    steps = F.split("branch", "/")
    asked = names.withColumn("step", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))))
    judged = asked.join(own, ["source", "step"], "left").join(common, "step", "left").withColumn("good", F.coalesce("good", "common"))
    return judged.groupBy("source", "branch").agg(F.coalesce(F.min("good"), F.lit(False)).alias("stays"))


def _low_leaves(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """``source`` and ``node`` of the leaves of low importance.

    ``pages``: ``source``, ``branch`` (empty for the whole source) and its pages ``of``.  Special forms are
    judged by their source where it shows the branch on ``ENOUGH`` pages, else by all sources.
    """
    forms = parts.groupBy("source", "branch", "node", "no", "style").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
    by = ["source", "branch", "node", "no"]
    total = forms.groupBy(*by).agg(F.sum("n").alias("all"), F.sum("pages").alias("on"))
    # a line without a form is one of its own
    part = F.when(F.col("style").isNull(), F.col("n") * _entropy(F.lit(1), F.col("all"))).otherwise(_entropy(F.col("n"), F.col("all")))
    plain = forms.filter("no = 0 AND branch <> 'text'").join(total.filter((F.col("on") >= MIN_PAGES) & (F.col("all") <= ONCE * F.col("on"))), by)
    same = plain.groupBy("source", "node").agg(F.sum(part).alias("mixed")).filter(F.col("mixed") < SAME_FORM).select("source", "node")
    special = total.filter("no = 1").select("source", "branch", "node", "on").join(pages, ["source", "branch"])
    often = (F.col("on") >= FORM_PAGES) & (F.log("on") > (1 - FURNITURE) * F.log("of"))
    everywhere = special.groupBy("node").agg(F.sum("on").alias("on"), F.sum("of").alias("of")).select("node", often.alias("common"))
    few = (F.col("of") < ENOUGH) & (F.col("branch") != "")
    low = special.join(everywhere, "node").filter(F.when(few, F.col("common")).otherwise(often)).select("source", "node")
    return same.unionByName(low).distinct()


def article_lines(df: DataFrame, source: str = "queue_id", page: str = "page", key: str = "request_id") -> DataFrame:
    """``key`` and ``line_no`` of every line of a page's own article.

    The branches and repeated contents of each source are learned from all its pages, from one parse of
    each.  Pages without markup are read as sections parted by blank lines.  Spam pages (``spam.judged``)
    have no article; null and empty pages have no lines; pages of a null source are judged by the tree of
    all sources; a key delivered twice comes once; an empty table gives no row; other columns are not read.
    """
    found = lines.with_repeated_lines(df, source, page, key, _parse, PARSED, FURNITURE, True, True, NAME)
    parsed = written(found, "parsed-pages", "part")
    tree = parsed.filter("part = 1")
    leaves = parsed.filter("part = 2")
    sizes = parsed.filter("part = 4").groupBy("source").agg(F.sum("pages").alias("of")).withColumn("branch", F.lit(""))
    pages = tree.groupBy("source", "branch").agg(F.sum("pages").alias("of")).unionByName(sizes)
    stays = style_tree(tree.select("source", "branch", "style", "pages", "weight", "spread"))
    stays = stays.filter((F.col("stays") & (F.col("branch") != "text side")) | (F.col("branch") == "text")).select("source", "branch")
    kept = parsed.filter("part = 0").select("key", "no", "source", "branch", "node")
    kept = kept.join(stays, ["source", "branch"], "left_semi").join(_low_leaves(leaves, pages), ["source", "node"], "left_anti")
    bad = spam.judged(parsed.filter("part = 3").select("key", "no", *spam.NAMES))
    return kept.select("key", "no").distinct().join(bad, "key", "left_anti").select(F.col("key").alias(key), F.col("no").alias("line_no"))
