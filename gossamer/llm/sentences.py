"""Problem 10: sentence boundaries across languages and scripts.

Whether a word with a full stop is an abbreviation is first settled inside the document, from places
where the same word stands unambiguously (with a stop before a small letter, or without any stop), then
by the same counts over the whole corpus, last by a short list.  Whether an abbreviation ends its sentence
is settled by the capitalised word behind it: one that the document also writes small, and never with a
capital inside a sentence, is no name.  Scripts have their own terminators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import written

#: Kinds whose lines are sentences each.
LINE_KINDS = ("log", "list")
#: Characters whose counts leave a task together; the sums don't depend on it.
BATCH_CHARS = 4_000_000
#: Occurrences from which corpus counts decide.
CORPUS_LEAST = 8
#: Share of a word's uses, in the corpus, in small letters from which it is no name.
SMALL = 0.1
#: Letters of a title, an abbreviation that only names follow.
TITLE = 4
#: Abbreviations of the corpus that may be sent to every task; beyond it each text is joined with its own.
MAX_SENT = 20_000

# Abbreviations of the corpus's languages for words the counts don't settle.
SHORT = frozenset(
    "Dr Mr Mrs Ms Prof St Sr Sra Dra Jr No Nos Nr Fig Figs Sec Vol Eq Ch Art al cf Cf vs approx ca etc usw usf bzw vgl Vgl Abschn Bd Kap Hr Fr Str Abb Tab evtl ggf inkl sog "
    "pág págs cap aprox núm ej env chap fig éd MM Mlle tél см См ср Ср рис Рис прим стр гл тыс др пр проф ред pp vol v p डॉ श्री nn ed eds Jan Feb Aug Sept Oct Nov Dec Mar Apr".split()
)
#: Those that may end a sentence.
FINAL = frozenset("etc usw usf p.m a.m al д п др пр Jr s Co Inc Ltd Corp гг руб".split())
#: Those that stand before names only.
TITLES = frozenset("Dr Mr Mrs Ms Prof St Sr Sra Dra Hr Fr MM Mlle проф".split())
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())

WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
#: A word with a full stop, and what follows.
DOTTED = re.compile(r"(?<![^\s(\[{“„«\"'‘/—–-])((?:[^\W\d_]+[.-])*[^\W\d_]+)\.(?=\s+(\S+)|[,;:)])")
MARK = re.compile(r"[.!?…؟।॥。！？｡۔։።፧။។៕]+")
#: Marks that always end a sentence: those of Devanagari, Urdu, Armenian, Ethiopic, Burmese and Khmer.
ALWAYS = "।॥۔։።፧။។៕"
#: The question mark of Greek, which looks like a semicolon.
GREEK_QUESTION = re.compile(r"(?<=[Ͱ-Ͽἀ-῿])[;;](?=\s)")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
CLOSERS = ")]}”’」』）】》»›"
OPENERS = "“„«\"'‘(¿¡[「『（"
#: Marks that end the word before them.
BEFORE = "(“„«\"‘[「『（/。！？，、：；”」』）…》"
CAP_WORD = re.compile(r"[“„«\"'‘(¿¡\[]*([^\W\d_]+)")
#: A word inside a sentence: a small letter, with a comma or not, stands before it.
INNER = re.compile(r"(?<=[^\W\d_A-Z])[,;]?\s([^\W\d_]+)")
#: A word that looks like a file, host or such may begin a sentence with a small letter.
NAMELIKE = re.compile(r"[\"“„«(]?(?=[0-9.]*[a-z])(?:[a-z0-9_-]+\.)+[a-z0-9]+|[“„«(]?(?:e\.g\.|i\.e\.)")
THAI = "฀-๿"
THAI_GAP = re.compile(rf"(?<=[{THAI}])([^\S\n]+)(?=[{THAI}])")
THAI_LATIN = re.compile(rf"(?<=[{THAI}])([^\S\n]+)(?=[“\"(]?[A-ZÀ-Ý])")
THAI_CHAR = re.compile(rf"[{THAI}]")
WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: Whatever may be asked for as an abbreviation.
STOPPED = re.compile(r"[^\W\d_]+(?:[.-]{1,2}[^\W\d_]+)*(?=\.)")
STOPPED_TAIL = re.compile(r"[^\W\d_぀-ヿ㐀-鿿豈-﫿]+(?:[.-]{1,2}[^\W\d_]+)*$")
INITIALS = re.compile(r"(?:[^\W\d_](?:\.-?|-))+[^\W\d_]")


class Known(NamedTuple):
    """What the corpus tells: abbreviations, those that may end a sentence, and ordinary words."""

    short: frozenset = frozenset()
    final: frozenset = FINAL
    plain: frozenset = frozenset()


def _uses(text: str):
    """(word, sort of what follows, that word in small letters) of every word with a full stop."""
    for m in DOTTED.finditer(text):
        nxt = m.group(2)
        if nxt is None:
            yield m.group(1), "low", None
            continue
        if NAMELIKE.match(nxt) or BLANK.search(text, m.end(), m.start(2)):
            yield m.group(1), "other", None
            continue
        w = CAP_WORD.match(nxt)
        if w is None:
            yield m.group(1), "digit" if nxt[0].isdigit() else "other", None
        elif w.group(1)[0].isupper():
            # an initial or another abbreviation is no sign of a new sentence
            yield m.group(1), "name", w.group(1).lower() if len(w.group(1)) > 1 and w.group(1) not in SHORT else None
        elif w.group(1)[0].islower():
            yield m.group(1), "low", None
        else:
            yield m.group(1), "other", None


COUNTS = ("plain", "low", "digit", "name", "other")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, next, plain, low, digit, name, other) over batches of texts; ``next`` is the capitalised
    word that follows, in small letters, or null."""
    plain: Counter = Counter()
    dotted: Counter = Counter()
    size = 0

    def out() -> pa.RecordBatch:
        rows: dict[tuple, list[int]] = {(w, None): [n, 0, 0, 0, 0] for w, n in plain.items()}
        for (w, sort, nxt), n in dotted.items():
            rows.setdefault((w, nxt), [0] * 5)[COUNTS.index(sort)] += n
        cols = list(zip(*((*k, *v) for k, v in rows.items()))) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(cols)], ["word", "next", *COUNTS])

    for b in batches:
        for t in b.column(0).to_pylist():
            plain.update(WORD.findall(t))
            dotted.update(x for x in _uses(t) if len(x[0]) <= 8)
            size += len(t)
            if size > BATCH_CHARS:
                yield out()
                plain, dotted, size = Counter(), Counter(), 0
    if plain:
        yield out()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """What the corpus settles by counts over all ``texts`` (one string column): ``word``, ``short``,
    ``final`` and ``plain``.

    Every use counts, wherever the batches and partitions end.  Ordinary words stand here only where
    they would else be taken for abbreviations.
    """
    sums = texts.mapInArrow(_counts, "word string, next string, " + ", ".join(f"{c} bigint" for c in COUNTS)).groupBy("word", "next").agg(*[F.sum(c).alias(c) for c in COUNTS])
    sums = written(sums, "word-counts")
    dots = F.col("low") + F.col("digit") + F.col("name") + F.col("other")
    # "plain" also counts the word where its stop follows
    often = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn("dots", dots).filter(F.col("dots") >= CORPUS_LEAST).withColumn("bare", F.greatest(F.col("plain") - F.col("dots"), F.lit(0)))
    often = written(often.filter((F.col("bare") <= 0.1 * F.col("dots")) | F.col("word").isin(*SHORT) | F.col("word").rlike(r"^.[.-]")), "words-in-doubt")
    # a word that is also written small, and not only now and then, is no name
    forms = sums.filter("next IS NULL AND plain > 0").groupBy(F.lower("word").alias("next")).agg(F.sum(F.when(F.col("word") == F.lower("word"), F.col("plain")).otherwise(0)).alias("small"), F.sum("plain").alias("all"))
    small = forms.filter((F.col("small") > 0) & (F.col("small") >= SMALL * F.col("all"))).select("next")
    after = sums.filter("next IS NOT NULL").select("word", "next", "name").join(often.select("word"), "word", "left_semi")
    common = after.join(small, "next", "left_semi").groupBy("word").agg(F.sum("name").alias("common"))
    c = often.join(common, "word", "left").withColumn("common", F.coalesce("common", F.lit(0))).withColumn("caps", F.col("name")).withColumn("name", F.col("caps") - F.col("common"))
    before = (F.col("low") + F.col("digit") >= 0.2 * F.col("dots")) | (F.length("word") <= TITLE) & (F.col("caps") > 0) & (F.col("name") >= 0.9 * F.col("caps"))
    short = before & (F.col("bare") <= 0.1 * F.col("dots"))
    final = short & (F.col("caps") >= 5) & (F.col("common") >= 0.3 * F.col("caps"))
    plain = ~before & (F.col("bare") > 0.1 * F.col("dots"))  # else the counts settle nothing
    return c.select("word", short.alias("short"), final.alias("final"), plain.alias("plain")).filter("short OR plain")


def known_of(rows) -> Known:
    """What the rows of ``corpus_counts`` tell."""
    rows = [(r["word"], r["short"], r["final"], r["plain"]) for r in rows]
    return Known(frozenset(r[0] for r in rows if r[1]), FINAL | {r[0] for r in rows if r[2]}, frozenset(r[0] for r in rows if r[3]))


class Document:
    """The words of one document in unambiguous places."""

    def __init__(self, text: str, known: Known):
        self.text, self.known = text, known
        self._plain: Counter | None = None
        self._dotted: dict[str, list[int]] | None = None
        self._names: Counter | None = None

    @property
    def plain(self) -> Counter:
        if self._plain is None:
            self._plain = Counter(WORD.findall(self.text))
        return self._plain

    def _uses(self, word: str) -> list[int]:
        """Places of the word with a full stop: before a small letter or a mark inside a sentence, before
        a digit, all."""
        if self._dotted is None:
            self._dotted = {}
            for m in DOTTED.finditer(self.text):
                c = self._dotted.setdefault(m.group(1), [0, 0, 0])
                c[2] += 1
                nxt = m.group(2)
                if nxt is None:
                    c[0] += self.text[m.end()] != ")"  # a sentence in brackets may end there
                elif not NAMELIKE.match(nxt) and not BLANK.search(self.text, m.end(), m.start(2)):
                    w = CAP_WORD.match(nxt)
                    c[0] += bool(w and w.group(1)[0].islower())
                    c[1] += nxt[0].isdigit()
        return self._dotted.get(word, [0, 0, 0])

    def _bare(self, word: str) -> bool:
        """Whether the word stands by itself without a stop, not as a part of a file name or such."""
        return re.search(rf"(?<![^\s(\[{{“„«\"'‘]){re.escape(word)}(?![^\s,;:!?)\]}}”»\"])", self.text) is not None

    def is_short(self, word: str) -> bool:
        """Whether the word is an abbreviation: by the document, then the corpus, last the list."""
        known = self.known
        listed = word in known.short or word in SHORT or INITIALS.fullmatch(word) is not None
        if len(word) > 8 and not listed:
            return False
        low, digit, dots = self._uses(word)
        # without a place before a small letter or a digit only a listed word is in doubt
        if low or listed:
            bare = self.plain.get(word, 0) > dots and (not listed or self._bare(word))
            if low and not bare:
                return True
            if bare and not low and not digit:
                return False
        if word in known.short:
            return True
        return listed and word not in known.plain

    def is_common(self, m: re.Match | None, stop: int) -> bool:
        """Whether the capitalised word of the match is an ordinary word that begins a sentence.

        The document writes it small elsewhere, never with a capital inside a sentence, and no second
        capitalised word follows as in a name.
        """
        if m is None or len(m.group(1)) < 2 or not m.group(1)[0].isupper() or not self.plain.get(m.group(1).lower()):
            return False
        after = CAP_WORD.match(self.text, m.end() + 1, stop) if m.end() < stop and self.text[m.end()].isspace() else None
        if after is None or not after.group(1)[0].islower():
            return False
        if self._names is None:
            self._names = Counter(w for w in INNER.findall(self.text) if w[0].isupper())
        return not self._names[m.group(1)]


def _opener_at(text: str, at: int, start: int, opener: str, closer: str) -> int:
    """Where the quotation that is closed at ``at`` was opened, or -1."""
    k = text.rfind(opener, start, at)
    return k if k >= 0 and text.find(closer, k + 1, at) < 0 else -1


def _close(text: str, k: int, start: int, end: int) -> tuple[int, str]:
    """The end after closing marks from ``k`` on, and the marks."""
    marks = ""
    while k < end:
        c = text[k]
        if c in CLOSERS:
            k += 1
        elif c == '"' and text.count('"', start, k) % 2:
            k += 1
        elif c in "“‘" and _opener_at(text, k, start, "„" if c == "“" else "‚", c) >= 0:
            k += 1
        elif c == "'" and text.count("'", start, k) % 2 and k + 1 < end and not text[k + 1].isalpha():
            k += 1
        elif c in "   \n" and k + 1 < end and text[k + 1] in "»›" and text.rfind("«", start, k) > text.rfind("»", start, k):
            k += 2
            c = text[k - 1]
        else:
            break
        marks += c
    return k, marks


def boundaries(text: str, known: Known = Known()) -> list[int]:
    """End positions (code points) of the sentences of running text."""
    out: list[int] = []
    doc = Document(text, known)
    at, n = 0, len(text)
    while at < n:
        m = BLANK.search(text, at)
        stop = m.start() if m else n
        _paragraph(text, at, stop, doc, out)
        at = m.end() if m else n
    return out


def _paragraph(text: str, at: int, stop: int, doc: Document, out: list[int]) -> None:
    while stop > at and text[stop - 1].isspace():
        stop -= 1
    while at < stop and text[at].isspace():
        at += 1
    if at >= stop:
        return
    ends = [_decide(text, m, at, stop, doc) for m in MARK.finditer(text, at, stop)]
    found = {e for e in ends if e}
    if GREEK_QUESTION.search(text, at, stop):
        found |= {m.end() for m in GREEK_QUESTION.finditer(text, at, stop)}
    if THAI_CHAR.search(text, at, stop):
        found |= {m.start() for m in THAI_GAP.finditer(text, at, stop)}
        for m in THAI_LATIN.finditer(text, at, stop):
            thai = THAI_CHAR.search(text, m.end(), stop)
            rest = text[m.end() : thai.start() if thai else stop]
            # a whole sentence in Latin script: it ends with a mark and holds small-letter words
            if re.search(r"[.!?][)”\"»]*\s*$", rest) and len(re.findall(r"\b[a-zß-ÿ]{2,}\b", rest)) >= 3:
                found.add(m.start())
    found.add(stop)
    # an end whose rest of the paragraph holds nothing but marks moves behind them
    out += sorted(found)


def _start_of_sentence(text: str, k: int, at: int) -> bool:
    """Whether nothing of the sentence stands before position ``k``."""
    j = k - 1
    while j >= at and text[j].isspace():
        j -= 1
    return j < at or text[j] in "。！？!?.…" or text[j] in "”」』" and j > at and text[j - 1] in "。！？"


def _decide(text: str, m: re.Match, at: int, stop: int, doc: Document) -> int:
    """The end of the sentence that the mark closes, or 0."""
    run, i, j = m.group(), m.start(), m.end()
    end, marks = _close(text, j, at, stop)
    if end >= stop:
        return stop
    nxt = text[end]
    last = run[-1]
    if last in "。！？｡":
        if nxt in "，、；,;—）)":
            return 0
        if marks:
            if "」" in marks or "』" in marks:
                return 0 if "ぁ" <= nxt <= "ゖ" or nxt in "」』" else end
            k = _opener_at(text, end - 1, at, "“", "”")
            if k < 0:
                k = text.rfind("“", at, end)
            if k >= 0 and _start_of_sentence(text, k, at):
                return 0  # a quotation that opens the sentence goes on with who said it
        else:
            # inside a quotation that goes on
            if text.count("「", at, i) > text.count("」", at, i):
                return 0
            if text.count("“", at, i) > text.count("”", at, i) and "”" in text[j:stop] and WIDE.search(text[j : j + 1] or " "):
                return 0
        return end
    if last in ALWAYS:
        return end
    if last == "…" and "." not in run and not any(c in "!?" for c in run):
        if not nxt.isspace():
            return 0
        return end if _starts(text, end, stop, doc, True) else 0
    if not nxt.isspace():
        # no blank: only a letter of a script without blanks begins a sentence here
        return end if last in "!?؟" and WIDE.match(nxt) and not marks else 0
    k = end
    while k < stop and text[k].isspace():
        k += 1
    if text[k] in "—–-,;:)»" and not (text[k] == "-" and k + 1 < stop and text[k + 1].isdigit()):
        return 0
    if last in "!?؟" or "!" in run or "?" in run:
        return end if _starts(text, end, stop, doc, bool(marks)) else 0
    if len(run) > 1:
        return end if _starts(text, end, stop, doc, True) else 0
    # one full stop
    b = i
    while b > at and not text[b - 1].isspace() and text[b - 1] not in BEFORE and not WIDE.match(text[b - 1]):
        b -= 1
    token = text[b:i]
    starts = _starts(text, end, stop, doc, True)
    if marks:
        return end if starts else 0
    if not token:
        return end if starts else 0
    if not token[-1].isalpha() and (token in SHORT or token in doc.known.short):
        return 0  # an abbreviation that ends in a combining mark
    if token[-1].isdigit() or not token[-1].isalpha():
        if b == at and token.isdigit():
            return 0  # the number of a list entry
        w = CAP_WORD.match(text, k, stop)
        if token.isdigit() and w and w.group(1) in MONTHS:
            return 0
        return end if starts else 0
    tail = re.search(r"[^\W\d_]+(?:[.-]{1,2}[^\W\d_]+)*$", token)
    word = tail.group() if tail else token
    whole = len(word) == len(token)
    if whole and len(word) == 1:
        if word in FINAL:
            return end if starts and not text[k].isdigit() else 0
        return 0  # an initial or a part of an abbreviation
    if whole and doc.is_short(word):
        if starts and not text[k].isdigit() and (word in doc.known.final or word not in TITLES and doc.is_common(CAP_WORD.match(text, k, stop), stop)):
            return end
        return 0
    return end if starts else 0


def _starts(text: str, end: int, stop: int, doc: Document, strict: bool) -> bool:
    """Whether what follows position ``end`` can begin a sentence."""
    k = end
    while k < stop and text[k].isspace():
        k += 1
    if k >= stop:
        return True
    if NAMELIKE.match(text, k, stop):
        return True
    while k < stop and text[k] in OPENERS:
        k += 1
    if k >= stop:
        return False
    c = text[k]
    if c in "—–":
        return False
    return not c.islower()


def line_ends(text: str) -> list[int]:
    """Ends of the non-empty lines, following whitespace excluded."""
    out, at = [], 0
    for line in text.split("\n"):
        kept = line.rstrip()
        if kept:
            out.append(at + len(kept))
        at += len(line) + 1
    return out


def sentence_ends(df: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind") -> DataFrame:
    """``key`` and ``end_pos`` (code points from the start of the text) of every sentence.

    Texts of the kinds log and list have a sentence a line.  Null, empty and blank texts have none; a
    null kind is running text; a text under several keys is cut for each; an empty table gives no row;
    other columns are not read.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.coalesce(F.col(kind), F.lit("")).alias("kind")).filter("text IS NOT NULL")
    counts = written(corpus_counts(rows.filter(~F.col("kind").isin(*LINE_KINDS)).select("text")), "abbreviations")
    few = counts.limit(MAX_SENT + 1).collect()

    def cut(batches: Iterator[pa.RecordBatch], have) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ends = [], []
            for k, t, how, *own in zip(*(c.to_pylist() for c in b.columns)):
                got = line_ends(t) if how in LINE_KINDS else boundaries(t, have if have is not None else known_of(own[0] or ()))
                ids += [k] * len(got)
                ends += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], [key, "end_pos"])

    schema = f"`{key}` bigint, end_pos bigint"
    if len(few) <= MAX_SENT:
        sent = df.sparkSession.sparkContext.broadcast(known_of(few))
        return rows.mapInArrow(lambda batches: cut(batches, sent.value), schema)
    # too many to be sent: each text meets the findings on its own words
    rows = rows.withColumn("print", F.xxhash64("text"))
    asked = rows.filter(~F.col("kind").isin(*LINE_KINDS)).select("print", "text").mapInArrow(_asked, "print bigint, word string").distinct()
    own = skew_join(asked, counts, "word").groupBy("print").agg(F.collect_list(F.struct("word", "short", "final", "plain")).alias("own"))
    return skew_join(rows, own, "print", "left").select("key", "text", "kind", "own").mapInArrow(lambda batches: cut(batches, None), schema)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, word) of the words and tokens with a full stop of each text."""
    for b in batches:
        prints, words = [], []
        for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = {w for x in STOPPED.findall(t) for w in (x, *STOPPED_TAIL.findall(x)) if len(w) <= 8}
            prints += [p] * len(own)
            words += own
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(words, pa.string())], ["print", "word"])
