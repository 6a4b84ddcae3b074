"""Page operators: garbled text, repeated lines, articles and spam."""

import random
from collections import Counter

import numpy as np
import pytest

from gossamer.llm import article, garbled, lines, pages, spam

from prose import PROSE

TEXTS = [
    "Größe und Zähler wären für Österreich „gut“ — ja",
    "L’été dernier, « la file » a été élargie à côté",
    "¿Cuándo terminará la tabla de máquinas del almacén?",
    "A execução não está na versão — ATENÇÃO",
    "Почему сортировщик рёбер посылает запросы на узел?",
    "为什么分发进程发送了请求，而主机表仍然没有响应？",
    "なぜ整列処理は要求を送り、待っているのですか？",
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "mac_roman", "cp1251"])
def test_garbled_utf8_is_restored(text, wrong):
    table = {b: c for c, b in garbled._byte_of(wrong).items()}
    bad = "".join(table[b] for b in text.encode())
    assert garbled.mend_line(bad) == (text, True)
    twice = "".join(table[b] for b in bad.encode())
    assert garbled.mend_line(twice) == (text, True)
    assert garbled.mend_line(text) == (text, False)


def test_garbled_between_legacy_encodings():
    for text, right, wrong in [(TEXTS[4], "koi8_r", "cp1251"), (TEXTS[5], "gbk", "latin_1"), (TEXTS[6], "euc_jp", "latin_1")]:
        assert garbled.mend_line(text.encode(right).decode(wrong)) == (text, True)


def test_garbled_pages(spark):
    bad = TEXTS[0].encode().decode("cp1252", "replace")
    ref = "caf&#195;&#169;"
    rows = [(1, "clean\n" + TEXTS[1]), (2, "clean\n" + bad), (2, "clean\n" + bad), (3, None), (4, ""), (5, "x" * 200_000), (6, ref), (7, "lost � mark"), (8, "a & b &amp; c")]
    df = spark.createDataFrame([(k, t, "f") for k, t in rows], "request_id bigint, page string, fixed string")
    got = {r.request_id: r.fixed for r in garbled.garbled(df).collect()}
    assert set(got) == {2, 6, 7} and got[6] == "café" and garbled.garbled(df.limit(0)).isEmpty()


def site(pages=30, seed=1):
    random.seed(seed)
    rows = []
    for k in range(pages):
        words = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randrange(3, 9))) for _ in range(n))
        body = f"<html><title>T{k}</title><body>\n<nav>\n<li>Home page</li>\n</nav>\n<main>\n<h1>{words(4)}</h1>\n<p>{words(30)}.</p>\n<p>Tell  a friend</p>\n<p>{words(25)}.</p>\n</main>\n<aside>\n<p>Most read here</p>\n<p><a href='/x'>{words(3)}</a></p>\n<p>All rights reserved by us forever and always</p>\n</aside>\n</body></html>"
        rows.append((k, 7, body))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "request_id bigint, queue_id int, page string, source string, again int").repartition(3)


def test_repeated_lines(spark):
    rows = [(k, 1, f"same <b>line</b>\r\nown {k}\n12\n") for k in range(10)] + [(k, 2, "same line\nother") for k in range(100, 109)] + [(100, 2, "same line\nother")] * 3 + [(200, None, "same line"), (201, 1, None), (202, 1, "")]
    df = frame(spark, rows)
    assert {(r.source, r.line, r.n) for r in lines.repeated_lines(df).collect()} == {(1, "same line", 10)}
    assert {(r.request_id, r.line_no) for r in lines.repeated_line_numbers(df).collect()} == {(k, 0) for k in range(10)}
    got = {r.request_id: r.page for r in lines.without_repeated_lines(df).collect()}
    assert got[3] == "own 3\n12\n" and got[200] == "same line" and got[201] is None
    assert lines.repeated_lines(df.limit(0)).isEmpty()


def test_summaries_lose_no_line_at_the_threshold():
    rng = np.random.default_rng(3)
    for counters in (1, 5, 50, 10_000):
        s = lines.Summary(counters, 10)
        total: Counter = Counter()
        for _ in range(60):
            prints, counts = np.unique(rng.zipf(1.3, 200).astype(np.uint64), return_counts=True)
            s.add(prints, counts)
            total.update(dict(zip(prints.tolist(), counts.tolist())))
        assert {p for p, n in total.items() if n >= 10} <= set(s.top().tolist())


def test_repeated_lines_by_join(spark, monkeypatch):
    df = frame(spark, [(k, 1, f"same line\nown {k}") for k in range(12)])
    monkeypatch.setattr(lines, "MAX_SENT_LINES", 0)
    monkeypatch.setattr(pages, "MAX_SENT_IDS", 0)
    assert {(r.request_id, r.line_no) for r in lines.repeated_line_numbers(df).collect()} == {(k, 0) for k in range(12)}
    assert {r.page for r in lines.without_repeated_lines(df).collect()} == {f"own {k}" for k in range(12)}


def test_articles(spark):
    rows = site()
    df = frame(spark, [*rows, rows[0], (900, 7, None), (901, None, "plain words here"), (902, 7, "")])
    got: dict = {}
    for r in article.article_lines(df).collect():
        got.setdefault(r.request_id, []).append(r.line_no)
    assert all(sorted(got[k]) == [5, 6, 8] for k in range(30)) and 900 not in got and 902 not in got
    assert article.article_lines(df.limit(0)).isEmpty()


def test_articles_of_many_sites(spark, monkeypatch):
    df = frame(spark, [*site(), *((1000 + r[0], 8, r[2]) for r in site(seed=2))])
    want = {tuple(r) for r in article.article_lines(df).collect()}
    assert len(want) == 180
    monkeypatch.setattr(lines, "MAX_SENT_LINES", 1)
    assert {tuple(r) for r in article.article_lines(df).collect()} == want


def test_articles_of_a_page_fetched_often(spark):
    rows = site()
    df = frame(spark, [*rows, *((500 + k, 7, rows[3][2]) for k in range(40))])
    got = article.article_lines(df).filter("request_id >= 500").collect()
    assert len(got) == 120 and {r.line_no for r in got} == {5, 6, 8}


def test_forms_of_single_lines_do_not_decide(spark):
    said = ["File > Preferences > Settings opens the dialog.", "In all cases a / b / c holds.", "In May 2003-05-06"]
    rows = site()
    rows = [(k, s, p.replace("</main>", f"<p>{said[k]}</p>\n</main>") if k < 3 else p) for k, s, p in rows]
    got = {(r.request_id, r.line_no) for r in article.article_lines(frame(spark, rows)).collect()}
    assert {(0, 9), (1, 9), (2, 9)} <= got


def test_text_page_sections():
    shown = ["Home | Docs", "", "Heading", "A sentence.", "", "Another one.", "", "", "Most read", "Unique side text", "", "", "All rights"]
    counts = [9 if x in {"Home | Docs", "Most read", "All rights"} else 0 for x in shown]
    got = article.text_branches(shown, counts)
    assert [k for k, (b, _) in enumerate(got) if b == "text" and shown[k] and not counts[k]] == [2, 3, 5]


@pytest.mark.parametrize("lang", list(PROSE))
def test_ordinary_prose_of_any_script_is_no_spam(lang):
    text = PROSE[lang]
    assert not spam.is_spam([text]) and not spam.is_spam([text] * 2)
    words = sorted({x.strip(".,;:،۔।։።") for x in text.replace("。", " ").replace("、", " ").split() if len(x) > 3})[:8]
    words = words if len(words) > 4 else [text[k : k + 3] for k in range(0, 24, 3)]
    random.seed(1)
    assert spam.is_spam([" | ".join(random.choice(words) for _ in range(150))])


def test_long_blocks_are_cut_whole():
    own = [" ".join(PROSE.values())] * 3
    assert "".join(x for x, _ in spam.blocks(own)) == "\n".join(own) and all(len(x) <= spam.PIECE for x, _ in spam.blocks(own))


def test_letters_of_any_script_keep_apart():
    for text in PROSE.values():
        if not spam.wide(text):
            assert len(spam.units(text)) == len(text) and len(set(spam.units(text))) == len(set(text))


def test_spam(spark):
    random.seed(4)
    kw = ["price", "cheap", "modem", "ticket", "online"]
    prose = "The archive was checked again by the team because several tables had no order. Nobody noticed the missing index until the second pass failed. We then wrote a short note about what went wrong and why it took so long."
    stuffed = "\n".join(" ".join(random.choice(kw) for _ in range(60)) for _ in range(4))
    linked = "\n".join(f"<a href='http://h{k}.example/'>{random.choice(kw)} Name{'abcdef'[k % 6]} {k * 37}</a>" for k in range(60))
    hidden = "<p>Short.</p>\n<div style=\"display:none\">" + stuffed.replace("\n", "</div>\n<div>") + "</div>"
    numbers = "\n".join(f"<tr><td>Row{k}</td><td>{k * 77}</td><td>{k / 3:.2f}</td></tr>" for k in range(60))
    rows = [(1, 1, prose), (2, 1, stuffed), (3, 1, linked), (4, 1, hidden), (5, 1, numbers + "\n" + prose), (6, 1, None), (7, 1, ""), (8, 1, "cheap"), (2, 1, stuffed)]
    df = frame(spark, rows)
    assert {r.request_id for r in spam.spam_pages(df).collect()} == {2, 3, 4}
    assert spam.spam_pages(df.limit(0)).isEmpty()


@pytest.mark.parametrize("lang", list(PROSE))
def test_clean_text_of_any_language_is_no_case(lang):
    text = PROSE[lang]
    for piece in [text, *text.split(), *text.split(". ")]:
        assert garbled.mend_line(piece) == (piece, False)


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "cp437", "mac_roman", "cp1251", "koi8_r", "cp1250"])
def test_text_of_any_language_is_restored(wrong):
    table = {b: c for c, b in garbled._byte_of(wrong).items()}
    texts = [t for t in PROSE.values() if not t.isascii() and all(b in table for b in t.encode())]
    assert len(texts) > 30 and all(garbled.mend_line("".join(table[b] for b in t.encode())) == (t, True) for t in texts)


def test_dear_patterns_run_only_where_they_may_match(monkeypatch):
    calls: Counter = Counter()

    class Counted:
        def __init__(self, name, pattern):
            self.name, self.pattern = name, pattern

        def __getattr__(self, what):
            calls[self.name] += 1
            return getattr(self.pattern, what)

    for module, name in [(article, "CODED"), (article, "DATE"), (article, "NAMES"), (spam, "CODE"), (spam, "ENTITY"), (garbled, "INNER"), (garbled, "LONE"), (garbled, "RUN")]:
        monkeypatch.setattr(module, name, Counted(name, getattr(module, name)))
    line = "plain words — “without” any number"
    assert article.form(line) == spam.masked(line) == line and article.special_form(line, frozenset()) == "" and garbled.cost(line) == 0
    assert not calls


def test_words_of_code_go_whole():
    odd = ["--foo=bar.baz", "--", "a.b", "./a", "x/y<b>", "<a.b", "a--b", "é=ß", "1.5", "end.", "&amp;", "--x", "a.b--c", "Name"]
    random.seed(2)
    for _ in range(2000):
        text = random.choice([" ", "  ", "\n"]).join(random.choice(odd) + random.choice(["", "", random.choice(odd)]) for _ in range(5))
        want = spam.NAME.sub("N", spam.NUMBER.sub("0", spam.CODE.sub("", spam.ENTITY.sub("·", text))))
        assert spam.masked(text) == " ".join(want.split())


def test_lines_are_hashed_as_utf8():
    for odd in ([], ["\ud800"]):
        own = ["", "a", "é", "日本", "😀", *odd]
        assert lines.digests(7, own) == [lines.digest(7, x) for x in own] and lines.digests(-2, own) == [lines.digest(-2, x) for x in own]


def test_capitals_inside_a_cyrillic_word_cost():
    assert garbled.cost("Привет Мир") == 0 and garbled.cost("пРИВЕТ ёЖ Мир") == pytest.approx(0.4 * 8)
