"""Problem 7: keyword-stuffed and link-list pages.

A page's own lines (those its site doesn't repeat) form blocks.  A block's compression ratio, with names
and numbers masked, is set against the ratio that ordinary text of its length, script and language has in
the corpus; extreme redundancy counts as spam where the block also lacks sentences, or where it is more
extreme still.  No block is spam without the compression test.

Pages are read once: each block leaves a narrow row of measures, the corpus's ordinary ratios are learned
from these rows, and the judgement is a plan over them.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import lines

#: Ratio of ordinary text where the corpus has too few blocks to tell: START at SIZE characters, falling by
#: SLOPE for each e-fold of length up to PIECE.
START, SLOPE, SIZE = 0.60, 0.088, 450
#: Blocks with sentences, of one script, language and length, from which their median ratio is the ordinary one.
LEARNED_FROM = 100
#: Share of the ordinary ratio below which a block is redundant, and extremely so; the same for a block
#: full of the marks that part tags and links, whose invented words vary more.
REDUNDANT, EXTREME, REDUNDANT_TAGS = 0.82, 0.535, 1.25
#: Marks for each 100 characters that make a block full of them.
TAGS = 2.0
#: Sentence ends for each 100 characters below which a block has no sentences.
SENTENCES = 0.34
#: Letters (names aside) a page's spam must hold, and its share of the page's own letters.
MIN_LETTERS, MIN_SHARE = 120, 0.5
#: Characters of a block without sentences and the share of the ordinary ratio below which it counts:
#: short lists are ordinary, so a short one must be the more redundant.
SHORT = ((230, 0.56), (300, 0.64), (400, REDUNDANT))
#: Characters a block with sentences must hold to count.
LEAST_SIZE = 250
#: Characters of a block at most; longer ones are cut, since a compressor's window makes ratios of very
#: different lengths incomparable.
PIECE = 6000

ENTITY = re.compile(r"&#?\w+;")
# Patterns begin with the character that tells them, so that a search runs over all others.
NUMBER = re.compile(r"\d\d*")
NAME = re.compile(r"[A-Z](?:(?<![^\W\d_].)|(?<=[぀-ヿ一-鿿].))[a-z]+")
#: File names, addresses and options are no prose either way.
CODE = re.compile(r"(?<!\S)(?:--\w+|[^\s<>]*\w[./=]\w[^\s<>]*)")
#: What each of them holds.
CODE_SIGN = re.compile(r"[./=\-](?:(?<=\w[./=])(?=\w)|(?<=-)(?=-))")
#: Letters that say as much as three of an alphabet.
WIDE = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣]")
#: Scripts that write no sentence mark part sentences by blanks: a long run before one counts as an end.
END = re.compile(r"[.!?…؟۔](?<!\d[.!?…])[)”\"»“]*(?=\s|$)")
END_WIDE = re.compile(r"[。！？｡।॥։።፧။។៕]")
END_RUN = re.compile(r"[฀-໿က-႟ក-៿]{18}(?=\s|$)")
#: What ``END`` and a letter count don't tell.
OTHER = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힣。！？｡।॥։።፧။។៕฀-໿က-႟ក-៿]")
LOOSE = "#[];|*•·"
DASH = re.compile(r"(?<!\S)-(?=\s)")
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
#: All bytes but letters and the mask of names.
NO_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127 or b == ord("N"))
HANGUL = re.compile(r"[가-힣]")
ASCII = np.arange(128, dtype=np.uint8)


def _without_code(text: str) -> str:
    """``text``, whose words are parted by single blanks, without what ``CODE`` finds."""
    out, at = [], 0
    for m in CODE_SIGN.finditer(text):
        start = text.rfind(" ", 0, m.start()) + 1
        if start >= at and (code := CODE.match(text, start)):
            out.append(text[at:start])
            at = code.end()
    return " ".join("".join([*out, text[at:]]).split()) if out else text


def masked(text: str, known: frozenset[str] = frozenset()) -> str:
    """Text with names and numbers replaced: what differs from entry to entry of a list.

    Capitalised words in ``known`` (those a page repeats) are words, not names.
    """
    t = " ".join(text.split())
    t = _without_code(ENTITY.sub("·", t) if "&" in t else t)
    t = NUMBER.sub("0", t)
    return NAME.sub(lambda m: m.group() if m.group() in known else "N", t) if known else NAME.sub("N", t)


def repeated_words(own: list[str]) -> frozenset[str]:
    """Capitalised words that stand at least three times on a page."""
    count = Counter(NAME.findall("\n".join(own)))
    return frozenset(w for w, n in count.items() if n > 2)


@lru_cache(maxsize=1)
def _scripts() -> tuple[np.ndarray, list[str], np.ndarray]:
    """The script's number of each code point up to U+FFFF (0: no letter and no sign of one), the scripts'
    names, and which code points are letters."""
    of, names, letter = np.zeros(65536, np.uint8), ["", "LATIN"], np.zeros(65536, bool)
    number = {"LATIN": 1}
    for k in range(65536):
        c = chr(k)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            name = re.split("[ -]", unicodedata.name(c, ""), maxsplit=1)[0]
            name = "CJK" if name in ("HIRAGANA", "KATAKANA", "HALFWIDTH", "FULLWIDTH") else name
            at = number.setdefault(name, min(len(number) + 1, 255))
            if at == len(names):
                names.append(name)
            of[k] = at
            letter[k] = kind == "L"
    return of, names, letter


def _codes(text: str) -> np.ndarray:
    """The text's code points; those beyond U+FFFF as the pairs of UTF-16."""
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def wide(text: str) -> int:
    """Letters that count as three."""
    return 0 if text.isascii() else len(WIDE.findall(text))


def units(text: str) -> bytes:
    """The text with one byte a letter, whatever its script; two where it needs more than 128 letters
    beyond ASCII (Han and such).  Different letters never share a byte."""
    if text.isascii():
        return text.encode()
    if HANGUL.search(text):
        text = unicodedata.normalize("NFD", text)
    codes = _codes(text)
    there = map(ord, set(text)) if len(codes) == len(text) else set(codes.tolist())
    own = sorted(k for k in there if k > 127)
    if len(own) > 128 or wide(text) > len(text) / 4:
        return codes.tobytes()
    byte = np.zeros(65536, np.uint8)
    byte[:128] = ASCII
    byte[own] = range(128, 128 + len(own))
    return byte[codes].tobytes()


def ratio(text: str) -> float:
    """Compressed share of a masked text."""
    raw = units(text)
    return (len(zlib.compress(raw, 6)) - 8) / max(len(raw), 1)


def script_and_letters(text: str) -> tuple[str, int]:
    """The script most letters of a masked text are of, and its letters but for masked names; a wide letter
    counts as three."""
    if text.isascii():
        return "LATIN", len(text.encode().translate(None, NO_LETTERS))
    codes = _codes(text)
    of, names, letter = _scripts()
    count = np.bincount(of[codes], minlength=2)
    count[0] = 0
    return names[int(count.argmax())] or "LATIN", int(letter[codes].sum()) - text.count("N") + 2 * wide(text)


def ends(text: str) -> int:
    """Sentence ends."""
    n = len(END.findall(text))
    return n if text.isascii() else n + len(END_WIDE.findall(text)) + len(END_RUN.findall(text))


def blocks(own: list[str]) -> list[tuple[str, float]]:
    """Consecutive lines without sentences make one block, and so do consecutive lines with them; each with
    its sentence ends for 100 characters (a wide letter counts as three).

    A block longer than ``PIECE`` is cut into even pieces; nothing of it is left out.
    """
    out: list[list] = []
    kind = None
    other = OTHER.search("\n".join(own))
    for s in own:
        n, size = (ends(s), len(s) + 2 * wide(s)) if other else (len(END.findall(s)), len(s))
        now = 100 * n >= SENTENCES * size
        if now != kind:
            out.append([[], 0, 0])
            kind = now
        last = out[-1]
        last[0].append(s)
        last[1] += n
        last[2] += size + 1
    pieces = []
    for texts, n, size in out:
        x = "\n".join(texts)
        step = -(-len(x) // -(-len(x) // PIECE)) if x else 1
        if len(x) <= step:
            pieces.append((x, 100 * n / max(size - 1, 1)))
        else:
            pieces += [(y, 100 * ends(y) / max(len(y) + 2 * wide(y), 1)) for y in (x[k : k + step] for k in range(0, len(x), step))]
    return pieces


#: What is measured of a block: script and declared language, characters, compressed share, sentence ends and
#: loose marks for each 100 characters, letters.
MEASURES = "script string, lang string, size int, got double, density double, loose double, letters int"
NAMES = [x.split(" ")[0] for x in MEASURES.split(", ")]


def measures(own: list[str], page: str = "") -> list[tuple]:
    """``MEASURES`` of the blocks of a page's own lines; ``page`` may declare its language."""
    if not own:
        return []
    declared = LANG.search(page)
    lang = declared.group(1).lower() if declared else ""
    known, out = repeated_words(own), []
    for b, dense in blocks(own):
        m = masked(b, known)
        kind, n = script_and_letters(m)
        loose = sum(map(b.count, LOOSE)) + (len(DASH.findall(b)) if "-" in b else 0)
        out.append((kind, lang, len(m), ratio(m) if n >= 40 else 1.0, dense, 100 * loose / max(len(b), 1), n))
    return out


def _default(size):
    """The ordinary ratio without knowledge of the corpus; level beyond ``PIECE``."""
    return START - SLOPE * math.log(min(max(size, 100), PIECE) / SIZE)


def is_redundant(size: int, got: float, ends: float, loose: float, ordinary: float) -> bool:
    """Whether a block is spam: its share of the ordinary ratio, confirmed by its lack of sentences."""
    share = got / ordinary
    if ends >= SENTENCES:
        return share < EXTREME and size >= LEAST_SIZE
    if loose > TAGS and size >= SHORT[-1][0]:
        return share < REDUNDANT_TAGS
    return any(size >= least and share < below for least, below in SHORT)


def is_spam(own: list[str], page: str = "") -> bool:
    """The judgement over the own lines of one page, against the default ratios."""
    bad = total = 0
    for _, _, size, got, ends, loose, n in measures(own, page):
        total += n
        bad += n if n >= 40 and is_redundant(size, got, ends, loose, _default(size)) else 0
    return bad >= MIN_LETTERS and bad >= MIN_SHARE * total


def _is_redundant(ordinary: Column) -> Column:
    """``is_redundant`` as a column."""
    share = F.col("got") / ordinary
    listed = (F.col("loose") > TAGS) & (F.col("size") >= SHORT[-1][0]) & (share < REDUNDANT_TAGS)
    for least, below in SHORT:
        listed = listed | ((F.col("size") >= least) & (share < below))
    return F.when(F.col("letters") < 40, False).when(F.col("density") >= SENTENCES, (share < EXTREME) & (F.col("size") >= LEAST_SIZE)).otherwise(listed)


def judged(blocks: DataFrame) -> DataFrame:
    """``key`` of the spam pages by the measures of all blocks (``key``, ``no`` and ``MEASURES``).

    The ordinary ratio of a block is the median over the corpus's blocks with sentences of its script,
    declared language and length (half powers of two); where there are fewer than ``LEARNED_FROM``, that
    of its script and length; else a fixed curve.  The tables of medians hold a row for each script,
    language code and length.
    """
    rows = blocks.withColumn("bucket", F.floor(2 * F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    usual = rows.filter((F.col("density") >= SENTENCES) & (F.col("letters") >= 40))
    med = [F.percentile_approx("got", 0.5, 1000).alias("m"), F.count(F.lit(1)).alias("c")]
    own = usual.groupBy("script", "lang", "bucket").agg(*med).filter(F.col("c") >= LEARNED_FROM).select("script", "lang", "bucket", F.col("m").alias("of_lang"))
    all_ = usual.groupBy("script", "bucket").agg(*med).filter(F.col("c") >= LEARNED_FROM).select("script", "bucket", F.col("m").alias("of_script"))
    known = rows.join(own, ["script", "lang", "bucket"], "left").join(all_, ["script", "bucket"], "left")
    default = F.lit(START) - SLOPE * F.log(F.least(F.greatest("size", F.lit(100)), F.lit(PIECE)) / SIZE)
    hit = known.withColumn("bad", F.when(_is_redundant(F.coalesce("of_lang", "of_script", default)), F.col("letters")).otherwise(0))
    # a page delivered twice has the same blocks twice
    once = hit.groupBy("key", "no").agg(F.max("bad").alias("bad"), F.max("letters").alias("letters"))
    pages = once.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("letters").alias("letters"))
    return pages.filter((F.col("bad") >= MIN_LETTERS) & (F.col("bad") >= MIN_SHARE * F.col("letters"))).select("key")


def measured_batch(rows: list[tuple]) -> pa.RecordBatch:
    """(key, no, *measures) rows."""
    cols = list(zip(*rows)) if rows else [[]] * 9
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "no", *NAMES])


def spam_pages(df: DataFrame, source: str = "queue_id", page: str = "page", key: str = "request_id") -> DataFrame:
    """``key`` of every page whose own text is mostly keywords, lists of links or product tags.

    The lines that a source repeats are set aside, garbled text is restored first, hidden text counts.
    Null and empty pages and pages without a source's own lines are no case; a key delivered twice comes
    once; an empty table gives no row; other columns are not read.
    """

    def measure(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, text, k, _, now, counts, _ in rows:
            own = measures([x for x, n in zip(now, counts) if x and not n], text)
            out += [(k, no, *m) for no, m in enumerate(own)]
            if len(out) > 10_000:
                yield measured_batch(out)
                out = []
        yield measured_batch(out)

    found = lines.with_repeated_lines(df, source, page, key, measure, f"key bigint, no int, {MEASURES}", lines.FURNITURE, True, True)
    return judged(written(found, "blocks")).select(F.col("key").alias(key))
