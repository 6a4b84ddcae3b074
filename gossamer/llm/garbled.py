"""Problem 1: text decoded with a wrong character encoding.

A line is taken back by a round trip: encoded under a candidate legacy encoding (the one it was wrongly
read with) and strictly decoded as the intended one, repeated for nested layers, accepted when a
garbling cost drops.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings the text may wrongly have been read with, and those it may have been written in.
SINGLE = ("cp1252", "latin_1", "cp437", "mac_roman", "cp850", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1250", "iso8859_15", "iso8859_7", "cp1253")
MULTI = ("gbk", "big5", "cp950", "shift_jis", "euc_jp", "euc_kr")
CYRILLIC_CODECS = ("cp1251", "koi8_r", "cp866", "iso8859_5")
INTENDED = ("utf-8", "cp1252", "cp1251", "koi8_r", "cp866", "gbk", "big5", "euc_jp", "cp932", "mac_roman", "cp437", "cp850")
LAYERS = 4
#: A repair is accepted when at most this share of the cost is left.
LEFT = 0.5
#: The same for a layer of at least four characters in strict UTF-8.
NESTED = 0.95
#: The same between two legacy encodings, whose strict decoding proves less than that of UTF-8.
LEFT_LEGACY = 0.3
WIDE_CODECS = ("gbk", "big5", "euc_jp", "cp932")

# Letters of the corpus's languages and the marks its texts use.
LATIN = "àâäçéèêëîïôöùûüßñáíóúãõœÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÑÁÍÓÚÃÕŒ"
MARKS = "“”„‘’‚«»‹›–—…•·§°©®™×δ€ºª¿¡ ­¶★→  ​‎‏﻿"
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"  # most frequent first
WIDE = "。、，！？：；（）「」『』【】《》〈〉・…〜～ー　％＆＋－＝０１２３４５６７８９／"

SUSPECT = re.compile(r"[^\x00-\x7e" + re.escape(LATIN + MARKS + WIDE) + r"А-Яа-яЁёぁ-ゖァ-ヺ一-鿿]")
ACCENT = "À-ÖØ-öø-ÿŒœŠšŽžŸ"
PAIR = re.compile(rf"[{ACCENT}¡-¿‚-‹][{ACCENT} -¿€ƒˆ˜‚„…†‡‰‹‘“•–™š›œžŸ]")
PAIR_OK = re.compile(r"(?:[öäüÖÄÜ]ß|[“”‘’„«»…—–]{2}|çã|çõ|ÇÃ|ÇÕ|ÃÇ|éé|ée|êé|ïé|¿[ÁÉÍÓÚáéíóú]|¡[ÁÉÍÓÚáéíóú]|«[ÀÂÉÈÊÎÔ¿¡]|[àâéèêîôûçáíóúãõñäöüßª]»|[“„‘][ÀÂÄÖÜÉÁÍÓÚ¿¡]|[àâéèêîôûçáíóúãõñäöüß][”“’…]|[’][àâéèêîôûÉ]|—[“„]|[…][”“»]|“‘|’”|»[…]|[»”’] |« | »|°»)")
# These patterns begin with the rarest character, so that a search runs over all others.
INNER = re.compile(r"[ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜÑÁÍÓÚÃÕ](?<=[a-zß-öø-ÿ].)")
LONE = re.compile(r"[ÂÇÈÊËÎÏÔÙÛÜÑÃÕùûñ](?<!\S.)(?=\s|$)")
SMALL_FIRST = re.compile(r"[à-öø-ÿ][A-Z]")
CAPITAL = re.compile(r"Ã(?=[^A-ZÀ-Ý]|$)")
#: Two letters beside each other, and a run of such letters as no language writes it.
TWO_LETTERS = re.compile(rf"[{ACCENT}]{{2}}")
SYMBOLS = "„‚•§©®™×€¡¿°"
INSIDE = re.compile(rf"[^\W\d_][{SYMBOLS}]+(?=[^\W\d_])")
RUN = re.compile(r"[À-ÖØ-öø-ÿ][À-ÖØ-öø-ÿ]{3,}")
CYRILLIC = re.compile(r"[А-Яа-яЁё][А-Яа-яЁё]*")
CAPITAL_INSIDE = re.compile(r"[А-ЯЁ](?<=[А-Яа-яЁё].)")
#: Letters of one script inside a word of another, as wrong guesses produce them.
MIXED = re.compile(r"[a-zß-ÿ][А-яЁё]|[А-яЁё][a-zß-ÿ]|(?<=[a-zß-ÿ ][a-zß-ÿ])[一-鿿ァ-ヺ](?=[a-zß-ÿ])")
SIGNED = frozenset(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
SMALL = frozenset(map(chr, (*range(0x61, 0x7B), *range(0xDF, 0x100))))
HAN = re.compile(r"[一-鿿]")
KANA = re.compile(r"[ぁ-ゖ]")
LETTER_COST = {c: i / 8 for i, c in enumerate(RUSSIAN)}


@lru_cache(maxsize=1)
def _common_han() -> tuple[frozenset, ...]:
    """First-level characters of the national sets of simplified, Japanese and traditional writing and all
    of the Japanese set, by their row ranges."""
    out = []
    for codec, rows, cells in (("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF)), ("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF)), ("big5", range(0xA4, 0xC7), (*range(0x40, 0x7F), *range(0xA1, 0xFF))), ("euc_jp", range(0xB0, 0xF5), range(0xA1, 0xFF))):
        own = set()
        for row in rows:
            for cell in cells:
                try:
                    own.add(bytes([row, cell]).decode(codec))
                except UnicodeDecodeError:
                    pass
        out.append(frozenset(own))
    return tuple(out)


@lru_cache(maxsize=1)
def _classes() -> tuple[frozenset, frozenset, frozenset, frozenset]:
    """Characters that cost nothing by themselves, and those whose neighbourhood matters."""
    ascii_ = {chr(i) for i in range(0x7F)}
    russian = set(RUSSIAN) | set(RUSSIAN.upper())
    kana = {chr(i) for i in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB))}
    accents = {chr(i) for i in range(0x80, 0x250)} | set("‚ƒ„…†‡ˆ‰‹‘’“”•–—˜™š›œžŸ€")
    han = frozenset().union(*_common_han())
    return frozenset(ascii_ | set(LATIN + MARKS + WIDE) | russian | kana | frozenset.intersection(*_common_han())), frozenset(accents), frozenset(russian), han


@lru_cache(maxsize=65536)
def _kind(c: str) -> tuple[str, str]:
    """The general category of a character and, for letters and what belongs to them, its script."""
    cat = unicodedata.category(c)
    script = unicodedata.name(c, "").split(" ")[0] if c > "\x7f" else "LATIN" if cat[0] == "L" else ""
    return cat, "CJK" if script in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "HANGUL", "BOPOMOFO") else script


def _odd(s: str) -> float:
    """What the characters cost that don't belong where they stand, whatever the language.

    Controls and lost characters always do; a letter or sign beside letters of another script, a capital
    behind a small letter, and a symbol inside or beside a word.  Letters among their like cost nothing.
    """
    c, n = 0.0, len(s)
    for m in SUSPECT.finditer(s):
        at, x = m.start(), m.group()
        cat, script = _kind(x)
        if cat in ("Cc", "Co", "Cn", "Cs") or x == "�":
            c += 3
            continue
        if cat == "Cf":
            continue
        before = _kind(s[at - 1]) if at else ("Zs", "")
        after = _kind(s[at + 1]) if at + 1 < n else ("Zs", "")
        near = [k for k in (before, after) if k[0][0] in "LM"]
        if cat[0] in "LM":
            if script == "MICRO":
                continue
            if "｡" <= x <= "ﾟ":
                c += 1  # half-width kana, which text of our time doesn't use
                continue
            strange = any(k[1] != script and not (k[0][0] == "M" and k[1] == "COMBINING" or script == "COMBINING") for k in near)
            if script in ("CJK", "FULLWIDTH", "HALFWIDTH"):
                strange = strange and any(k[0] in ("Ll", "Lo") and k[1] != "CJK" for k in (before,)) and after[0] == "Ll"
            c += 2 if strange else cat == "Lu" and before[0] == "Ll"
        elif near and not any(k[1] == script for k in near):
            # exponents and marks that close a word
            fine = cat == "No" and before[0][0] == "L" and after[0][0] != "L" or cat in ("Pf", "Pe", "Pi", "Ps", "Pd") and len(near) == 1
            c += 0 if fine else 2
        elif cat[0] == "S" and (before[0][0] == "S" or after[0][0] == "S"):
            c += 1
    return c


def _han_cost(s: str, han: list[str]) -> float:
    """Characters outside the common ones of the one national set that fits best; beside kana only the
    Japanese set fits."""
    *first, japanese = _common_han()
    return 1.5 * min(sum(1 for x in han if x not in own) for own in ((japanese,) if KANA.search(s) else first))


def cost(s: str) -> float:
    """Garbling cost: characters and neighbourhoods that clean text of any language lacks."""
    if s.isascii():
        return 0.0
    c = 0.0
    safe, accents, russian, common = _classes()
    chars = set(s)
    if not chars <= safe:
        c += _odd(s)
        han = HAN.findall(s)
        if han:
            c += _han_cost(s, han)
    if not chars.isdisjoint(accents):
        for m in PAIR.finditer(s):
            two = m.group()
            if TWO_LETTERS.fullmatch(two):
                # small letters stand beside each other in many languages
                c += two[1].isupper() and not (two[0].isupper() and s[m.end() : m.end() + 1].isupper())
            elif not PAIR_OK.match(two):
                c += 1
        if not chars.isdisjoint(SIGNED):
            c += len(INNER.findall(s)) + len(CAPITAL.findall(s)) + sum(len(x) for x in RUN.findall(s) if len(set(x.lower())) > 2)
            c += len(LONE.findall(s)) + len(SMALL_FIRST.findall(s))
    if not chars.isdisjoint(SYMBOLS):
        c += len(INSIDE.findall(s))
    slavic = not chars.isdisjoint(russian)
    if (slavic or not chars.isdisjoint(common)) and not chars.isdisjoint(SMALL):
        c += 1.5 * len(MIXED.findall(s))
    if slavic:
        words = CYRILLIC.findall(s)
        every = "".join(words)
        n, rank = len(every), sum(map(LETTER_COST.__getitem__, every.lower()))
        if CAPITAL_INSIDE.search(s):
            for w in words:
                if w[1:] != w[1:].lower():
                    c += 0.4 * len(w)
        if n >= 10 and rank / n > 1.7:
            c += (rank / n - 1.4) * n  # rare letters prevail
    return c


@lru_cache(maxsize=64)
def _byte_of(codec: str) -> dict[str, int]:
    """Characters of a single-byte encoding; bytes it leaves undefined and C1 controls stand for themselves."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    have = set(out.values())
    for b in range(128, 256):
        if b not in have or b < 160:
            out.setdefault(chr(b), b)
    if codec == "cp1252":
        for b in range(160, 256):
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=64)
def _encodable(codec: str) -> re.Pattern:
    chars = "".join(c for c in _byte_of(codec) if ord(c) > 127)
    return re.compile("[\x00-\x7f" + re.escape(chars) + "]*[" + re.escape(chars) + "][\x00-\x7f" + re.escape(chars) + "]*")


UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _to_bytes(s: str, codec: str) -> bytes | None:
    if codec in MULTI:
        try:
            return s.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return bytes(map(_byte_of(codec).__getitem__, s))
    except KeyError:
        return None


def _strict(s: str, wrong: str, right: str) -> str | None:
    raw = _to_bytes(s, wrong)
    if raw is None:
        return None
    try:
        return raw.decode(right)
    except UnicodeDecodeError:
        return None


def _pieces(s: str, wrong: str) -> str | None:
    """The valid UTF-8 sequences inside ``s``; what lost bytes is left as it is."""
    table = _byte_of(wrong)
    changed = False

    def one(m: re.Match) -> str:
        nonlocal changed
        raw, out, at = bytes(map(table.__getitem__, m.group())), [], 0
        text = m.group()
        for k in UTF8.finditer(raw):
            try:
                got = k.group().decode()
            except UnicodeDecodeError:
                continue
            out += [text[at : k.start()], got]
            at = k.end()
            changed = True
        return "".join([*out, text[at:]])

    got = _encodable(wrong).sub(one, s)
    return got if changed else None


def _stretches(s: str, wrong: str, right: str) -> str | None:
    """Strict round trips of the stretches that ``wrong`` can write; the characters between them stay."""
    table, ok = _byte_of(wrong), True

    def one(m: re.Match) -> str:
        nonlocal ok
        try:
            return bytes(map(table.__getitem__, m.group())).decode(right)
        except UnicodeDecodeError:
            ok = False
            return m.group()

    got = _encodable(wrong).sub(one, s)
    return got if ok and got != s else None


def _layer(s: str, before: float, deep: bool = True, hints: list | None = None) -> tuple[str, float] | None:
    """The cheapest strict round trip of ``s``, if it lowers the cost enough.

    ``hints`` are the encoding pairs that mended earlier lines of the page: they are tried first and
    taken when they leave no cost.
    """
    best: tuple[str, float] | None = None
    for wrong, right in hints or ():
        t = _strict(s, wrong, right)
        if t is not None and t != s and before >= 1 and cost(t) == 0:
            return t, 0.0

    def offer(t: str | None, left: float = LEFT) -> bool:
        nonlocal best
        if t is None or t == s:
            return False
        c = cost(t)
        if c <= left * before and before - c >= 1 and (best is None or c < best[1]):
            best = (t, c)
        return c == 0 and best is not None

    for wrong in SINGLE + MULTI[:3]:
        t = _strict(s, wrong, "utf-8")
        # several sequences that all decode prove more than the cost of a layer that hides another one
        if offer(t, NESTED if t is not None and len(s) - len(t) >= 4 else LEFT):
            if hints is not None:
                hints.append((wrong, "utf-8"))
            return best
    if best is not None:
        return best
    for wrong in SINGLE[:5]:
        if offer(_pieces(s, wrong)):
            return best
    if best is not None:
        return best
    # a nested layer may leave garbling as dear as its own: let such a step pass if the next one pays
    for wrong in SINGLE[:5] if deep else ():
        t = _strict(s, wrong, "utf-8")
        if t is not None and t != s and len(t) < len(s):
            again = _layer(t, max(cost(t), 0.5), False)
            if again is not None and again[1] <= LEFT * before:
                return again
    for right in INTENDED[1:]:
        for wrong in SINGLE[:8] + MULTI:
            if right == wrong or wrong in CYRILLIC_CODECS and right in WIDE_CODECS and before < 8:
                continue
            raw = _to_bytes(s, wrong)
            if raw is None:
                t = _stretches(s, wrong, right) if wrong in SINGLE else None
            else:
                try:
                    t = raw.decode(right)
                except UnicodeDecodeError:
                    continue
            if offer(t, LEFT_LEGACY):
                if hints is not None and raw is not None:
                    hints.append((wrong, right))
                return best
    return best


def _nested(s: str, hints: list | None = None) -> str | None:
    now, c, changed = s, cost(s), False
    for _ in range(LAYERS):
        if not c:
            break
        got = _layer(now, c, True, hints)
        if got is None:
            break
        now, c = got
        changed = True
    return now if changed else None


def mend_line(line: str, hints: list | None = None) -> tuple[str, bool]:
    """``line`` with the original text where it can be recovered, and whether it was garbled.

    A replacement character U+FFFD shows a wrong decoding that can't be undone.  Character references
    are read as the characters they name.
    """
    text = html.unescape(line) if "&" in line else line
    if text.isascii():
        return line, False
    c = cost(text)
    if c < 1:
        return line, False
    lost = "�" in text
    if lost:
        # bytes are gone where U+FFFD stands: the pieces between them may still be taken back
        parts = [(_nested(x, hints) or x) if cost(x) >= 2 else x for x in text.split("�")]
        return "�".join(parts), True
    got = _nested(text, hints)
    if got is None and text != line and not line.isascii():
        got = _nested(line, hints)  # references of clean marks beside garbled letters
    if got is None:
        # parts of the line may be clean: take the stretches that one encoding can write
        out, changed = text, False
        for wrong in ("cp1252", "cp437", "mac_roman", "koi8_r", "cp1251"):
            parts = _encodable(wrong).findall(text)
            for p in sorted(set(parts), key=len, reverse=True):
                before = cost(p)
                if before >= 2 and len(p) < len(text):
                    fixed = _layer(p, before)
                    if fixed is not None:
                        out, changed = out.replace(p, fixed[0]), True
            if changed:
                break
        got = out if changed else None
    if got is None:
        return line, False
    return got, True


class Mender:
    """Pages line by line, remembering clean lines met before."""

    def __init__(self):
        self.clean: set[str] = set()

    def page(self, text: str) -> tuple[str, bool]:
        if text.isascii() and "&#" not in text and not NAMED.search(text):
            return text, False
        hit, out, hints, clean = False, [], [], self.clean
        if len(clean) > 50_000:
            clean.clear()
        for s in text.split("\n"):
            if s in clean or s.isascii() and ("&" not in s or "&#" not in s and not NAMED.search(s)):
                out.append(s)
                continue
            t, bad = mend_line(s, hints)
            out.append(t)
            if bad:
                hit = True
            else:
                clean.add(s)
        return ("\n".join(out), True) if hit else (text, False)


#: Named references of letters and marks beyond ASCII, as garbled text would show them.
NAMED = re.compile(r"&(?:[AEIOUYaeiouyNnCcSszZ](?:grave|acute|circ|tilde|uml|ring|cedil|caron|slash)|[AaOo][Ee]lig|euro|trade|[lrsb]d?quo|curren|yen|pound|cent|sect|para|macr|ETH|eth|THORN|thorn|szlig|permil|dagger|fnof|iexcl|iquest|ord[fm]|sup[123]|frac\d\d|micro|not|shy|plusmn);")


def garbled(df: DataFrame, key: str = "request_id", page: str = "page") -> DataFrame:
    """``key`` and ``fixed`` of every page that holds wrongly decoded text.

    ``fixed`` is the page with its garbled lines restored where possible, else as they stand.  Null and
    empty pages are no case; a key delivered twice comes once; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mender()
        for b in batches:
            ids, fixed = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got, hit = m.page(t)
                if hit:
                    ids.append(k)
                    fixed.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fixed, pa.string())], [key, "fixed"])

    rows = df.filter(F.col(page).isNotNull()).select(F.col(key).cast("bigint"), page)
    return rows.mapInArrow(run, f"`{key}` bigint, fixed string").groupBy(key).agg(F.max("fixed").alias("fixed"))
