"""Document operators: leaks and sentences."""

import random

import pytest

from gossamer.llm import leaks, sentences


def test_leaks_against_brute_force(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40)), "en") for k in range(6)] + [(9, "今天我们要检查所有主机表里的重定向是否仍然有效并且写入日志文件然后继续", "zh"), (10, None, "en"), (11, "", None)]
    docs = []
    for k in range(40):
        own = [word() for _ in range(60)]
        part = items[k % 6][1].split()
        n = random.choice([8, 9, 10, 15])
        at = random.randrange(0, 40 - n)
        own[20:20] = [w.upper() if k % 2 else w + "," for w in part[at : at + n]]
        docs.append((k, " ".join(own)))
    zh = items[6][1]
    docs += [(100, "x" + zh[3:24] + "。"), (101, zh[3:20]), (102, zh[3:13] + " ，\n" + zh[13:25]), (103, None), (104, ""), (105, "word " * 30_000), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, kind int").repartition(3)
    i = spark.createDataFrame([(*x, "k") for x in items], "item_id bigint, text string, lang string, ids string")
    want = set()
    for a, t in docs:
        for b, s, lang in items:
            if t and s:
                kind = int(lang == "zh")
                x, y = (leaks.tokens_of(v, kind) for v in (t, s))
                n = (10, 18)[kind]
                grams = {tuple(y[k : k + n]) for k in range(len(y) - n + 1)}
                if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)):
                    want.add((a, b))
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()} == want and want
    assert leaks.leaked_items(d.limit(0), i).isEmpty() and leaks.leaked_items(d, i.limit(0)).isEmpty()


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    random.seed(6)
    items = [(k, " ".join(f"w{random.randrange(500)}" for _ in range(30)), "en") for k in range(9)]
    docs = [(k, "some words before " + items[k % 9][1][20:90] + " and after") for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    want = {tuple(r) for r in leaks.leaked_items(d, i).collect()}
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 4)
    assert {tuple(r) for r in leaks.leaked_items(d, i).collect()} == want and len(want) == 30


def test_reworded_passages(spark):
    items = [(1, "Suppose that Eoorm must visit 12701 sites while Ropell keeps only 2859 open queues, so that each request to Latelsima waits until Quikelnix has emptied buffer 7117.", "en"), (2, None, "en")]
    docs = [(1, "We suppose Eoorm must first visit 12701 different sites while old Ropell keeps just 2859 open message queues, so each new request to Latelsima waits until poor Quikelnix emptied the buffer 7117."), (2, "Nothing here is about it " * 20), (3, None), (4, "")]
    docs += [(10 + k, f"so that only the list has {k} entries while each has been read") for k in range(40)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string, lang string")
    got = [(r.doc_id, r.item_id, r.run < 10, r.lcs > 15, r.answers > 3) for r in leaks.similar_passages(d, i).collect()]
    assert got == [(1, 1, True, True, True)]
    assert leaks.similar_passages(d.limit(0), i).isEmpty()


def cut(text):
    out, at = [], 0
    for e in sentences.boundaries(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "want",
    [
        ["Dr. A. Smith and Prof. B. Jones met at 5 p.m. on Monday.", "They left."],
        ["The tables, lists, etc. are full.", "See Fig. 3, cf. p. 12."],
        ["It covered hosts, aliases, etc.", "The rest failed."],
        ["“Is it ready?” asked Y. Ban.", "It waited... and then it ran.", "Why?!", "robots.txt was missing."],
        ["(All files were checked.)", "Done!"],
        ["Am 3. März lief es, d. h. etwa 7 mehr als z. B. Nr. 5.", "„Läuft es?“, fragte er.", "Er schrieb: „Es ist voll.“", "Gut."],
        ["« Est-il prêt ? » demanda M. Dupont.", "Il écrivit : « Tout est plein. »", "Voir p. 7."],
        ["¿Quién borró x.idx?", "¡No borren nada!", "El Sr. Gil dijo «listo»."],
        ["«Готов ли он?» — спросил R. Ким.", "См. рис. 5, где показаны ранги и т. д.", "Это прим. 64 страниц, т. к. он работает."],
        ["“他能处理吗？”B. Li在邮件里问道。", "K说：“请先停止，还有没有处理。”", "然后继续……直到队列为空。"],
        ["Sさんは「止めてください。」と書いた。", "なぜだろう？", "動いた！"],
        ["تمام انسان آزاد پیدا ہوئے ہیں۔", "انہیں عقل ودیعت ہوئی ہے۔", "کیا یہ درست ہے؟"],
        ["Բոլոր մարդիկ ծնվում են ազատ։", "Նրանք ունեն բանականություն։"],
        ["የሰው ልጅ ሁሉ ሲወለድ ነጻ ነው።", "ሕሊና አለው።"],
        ["လူတိုင်းသည် လွတ်လပ်သည်။", "သူတို့သည် ဆက်ဆံသင့်၏။"],
        ["មនុស្សទាំងអស់ កើតមកមានសេរីភាព។", "ពួកគេមានសិទ្ធិ។"],
        ["Είναι έτοιμος ο πίνακας;", "Ναι, είναι έτοιμος.", "Τι έγινε;", "Τίποτα."],
        ["ﾊｲ､ｿｳﾃﾞｽ｡", "ｵﾜﾘ｡"],
        ["क्या वह तैयार है?", "डॉ. A. Rao ने जाँचा।", "क्यों नहीं?"],
        ["هل هو جاهز؟", "كتب د. Ali أن ذلك صحيح.", "لم يكن هذا السبب."],
        ["นั่นไม่ใช่สาเหตุ", "ระบบ Alpha รุ่น 2.1 ทำงาน", "คุณ B. Q ย้าย"],
    ],
)
def test_sentences(want):
    assert cut(" ".join(want) if not any("一" <= c <= "ヺ" or "ぁ" <= c <= "ゖ" for s in want for c in s) else "".join(want)) == want
    assert cut("\n\n".join(want)) == want


def test_layout_of_paragraphs(spark):
    text = "A heading\n\nHello all,\n \nOne line\nwraps here. Next 👍🏽 one.  \n\nName"
    assert cut(text) == ["A heading", "Hello all,", "One line\nwraps here.", "Next 👍🏽 one.", "Name"]
    rows = [(1, text, "mail"), (2, "a b.c d.\n\n  x \n", "log"), (3, None, "log"), (4, "", "list"), (5, " \n\t ", "note"), (6, "No. 5 is x", None), (7, "Sentence. " * 20_000, "note")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, kind string, word int")
    got: dict = {}
    for r in sentences.sentence_ends(df).collect():
        got.setdefault(r.doc_id, []).append(r.end_pos)
    assert sorted(got[2]) == [8, 13] and set(got) == {1, 2, 6, 7} and len(got[7]) == 20_000
    assert all(text[e - 1 : e].strip() for e in got[1])
    assert sentences.sentence_ends(df.limit(0)).isEmpty()


def test_a_word_is_settled_by_the_document():
    text = "The abt. value rose. We saw the abt. Value Nine again."
    assert cut(text) == ["The abt. value rose.", "We saw the abt. Value Nine again."]


def test_the_document_goes_before_the_corpus_and_the_list():
    plain = sentences.Known(plain=frozenset(["qty"]))

    def cut_by(text, known):
        ends = sentences.boundaries(text, known)
        return [text[a:b].strip() for a, b in zip([0, *ends], ends)]

    # listed or settled by the corpus, but an ordinary word here
    assert cut_by("His Art is old. He sold Art. Then they left.", sentences.Known()) == ["His Art is old.", "He sold Art.", "Then they left."]
    assert cut_by("The qty is five. It has qty. Then it fell.", sentences.Known(short=frozenset(["qty"])))[1:] == ["It has qty.", "Then it fell."]
    # ordinary in the corpus, but an abbreviation here
    assert cut_by("Set qty. to five. The qty. Rows came.", plain) == ["Set qty. to five.", "The qty. Rows came."]
    # the corpus goes before the list
    assert cut_by("He sold Art. Then they left.", sentences.Known(plain=frozenset(["Art"]))) == ["He sold Art.", "Then they left."]
    # an ordinary word, no name, follows
    assert cut_by("We drop it approx. The queue waits, but the host waits.", sentences.Known()) == ["We drop it approx.", "The queue waits, but the host waits."]
    # neither a file name nor another paragraph tells
    assert cut_by("See the file x.cf or y, cf. No. 5. It ends in cause.\n\nif x. So is the cause.\n\nif y. It is the cause. No more.", sentences.Known())[-1] == "No more."


def test_corpus_counts_hold_every_use(spark, monkeypatch):
    texts = [f"Row {k} has qnt. of x." for k in range(9)] + [f"The wub {k} is on." for k in range(60)] + [f"It has a wub. Then {k} came." for k in range(9)]
    rows = [(k, t, "note") for k, t in enumerate(texts)] + [(500, "It shows qnt. Rows and 今qnt. Rows here.", "note"), (501, "He has qnt. Rows.", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string").repartition(20)
    monkeypatch.setattr(sentences, "BATCH_CHARS", 30)  # one use a batch
    got = {r["word"]: (r["short"], r["plain"]) for r in sentences.corpus_counts(df.select("text")).collect()}
    assert got.get("qnt") == (True, False) and "wub" not in got
    want = {tuple(r) for r in sentences.sentence_ends(df).collect()}
    assert {e for k, e in want if k == 501} == {17}
    monkeypatch.setattr(sentences, "MAX_SENT", 0)  # by join
    assert {tuple(r) for r in sentences.sentence_ends(df).collect()} == want


def test_passages_hold_every_leak(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40)), "en") for k in range(4)]
    # a short leak among other words, and items whose leaks are a third of the documents
    docs = [(k, " ".join([*(word() for _ in range(60)), *items[k % 4][1].split()[12 : 22 + k % 3], *(word() for _ in range(60))])) for k in range(20)]
    docs += [(100 + k, " ".join(word() for _ in range(80))) for k in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string, lang string")
    got = {(r.doc_id, r.item_id): r for r in leaks.similar_passages(d, i).collect()}
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, i).collect()} <= set(got)
    assert all(got[k, k % 4].run == 10 + k % 3 == got[k, k % 4].lcs and got[k, k % 4].answers == 10 + k % 3 for k in range(20))
