"""Seen keys, formatting variants and tokens: exact on small tables, defined for dirty ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gossamer.llm import bpe, mphf, seen, variants


def test_sealed_partition_holds_its_keys():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 20_000, np.int64)
    keys = np.unique(keys)
    prints = rng.integers(0, 2**32, len(keys), np.uint32)
    s = mphf.Sealed(keys, prints)
    assert s.has(keys, prints).all() and not s.has(keys, prints + np.uint32(1)).any()
    other = rng.integers(-(2**63), 2**63 - 1, 20_000, np.int64)
    assert s.has(other, rng.integers(0, 2**32, len(other), np.uint32)).sum() == 0
    assert s.nbytes() < 6 * len(keys)
    assert not mphf.Sealed(keys[:0], prints[:0]).has(keys, prints).any()


def test_seen_before(spark, monkeypatch):
    monkeypatch.setattr(seen, "BATCH_ROWS", 64)
    random.seed(1)
    rows = [(k, random.choice(["hot", None, "", "É", f"k{random.randrange(300)}"]), k) for k in range(1500)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, key string, tab bigint").repartition(5)
    got = {r.rec_id for r in seen.seen_before(df, "t", "id", "key").collect()}
    first: dict = {}
    for i, k, _ in sorted(rows):
        first.setdefault(k, i)
    assert got == {i for i, k, _ in rows if k is not None and first[k] < i}
    rate = seen.error_rate(df, "t", "id", "key").first()
    assert (rate.n_wrong, rate.rate, rate.n_seen) == (0, 0.0, len(got))
    assert seen.seen_before(df.limit(0), "t", "id", "key").isEmpty()
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id bigint, key string")
    assert seen.seen_before(twice, "t", "id", "key").isEmpty()


def test_sealed_index_over_batches(spark, tmp_path):
    random.seed(3)
    rows = [(k, random.choice(["hot", None, "", f"k{random.randrange(200)}"])) for k in range(900)]
    where, got = str(tmp_path / "index"), set()
    for n, at in enumerate(range(0, 900, 300)):
        batch = spark.createDataFrame(rows[at : at + 300], "id bigint, key string").repartition(3)
        index = spark.read.schema("shard int, n bigint, blob binary").parquet(where) if n else spark.createDataFrame([], "shard int, n bigint, blob binary")
        got |= {r.rec_id for r in seen.seen_in_index(batch, "t", "id", "key", index, 5).collect()}
        seen.seal(batch, "key", 5).write.mode("append").parquet(where)
    first: dict = {}
    for i, k in rows:
        first.setdefault(k, i)
    assert got == {i for i, k in rows if k is not None and first[k] < i}


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("http://A.com/x?b=1&a=2", " http://a.com//x?a=2;&b=1& ", True),
        ("http://a.com/x?b=1&a=2", "http://a.com/x?b=2&a=1", False),
        ("http://a.com/x", "https://a.com/x", False),
        ("http://a.com/x-y", "http://a.com/xy", False),
        ("http://a.com/x?a=1&a=1", "http://a.com/x?a=1", True),
    ],
)
def test_url_form(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(variants.url_form(F.col("a")).alias("a"), variants.url_form(F.col("b")).alias("b")).first()
    assert (r.a == r.b) == same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("www.a-b.com", "Com/a_b/WWW", True), ("www.a-b.com", "www a b com", True), ("a.www.com", "www.a.com", False), (" www . a . example ", "(www.a.example)", True), ("x.y", "y.x", True)],
)
def test_host_form(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(variants.host_form(F.col("a")).alias("a"), variants.host_form(F.col("b")).alias("b")).first()
    assert (r.a == r.b) == same


@pytest.mark.parametrize("rows_each", [1, 500_000])
def test_variant_groups(spark, monkeypatch, rows_each):
    monkeypatch.setattr(variants, "RANGE_ROWS", rows_each)
    rows = [(1, "A b"), (2, "a  B!"), (3, "ab"), (4, None), (5, None), (6, ""), (6, ""), (7, "--"), (8, "long " * 5000), (9, "LONG " * 5000), (2, "a  B!")] + [(100 + k, "hot key") for k in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x string").withColumn("h", F.lit(1)).withColumn("form", F.lit("z")).repartition(4)
    got = {(r.tab, r.keep_id, r.dup_id) for r in variants.variant_groups([(df, "t", "id", variants.words(F.col("x")))]).collect()}
    assert got == {("t", 1, 2), ("t", 6, 7), ("t", 8, 9)} | {("t", 100, 100 + k) for k in range(1, 300)}
    assert variants.variant_groups([(df.limit(0), "t", "id", variants.words(F.col("x")))]).isEmpty()


def test_bpe_equals_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    texts = ["Hello  world's <|endoftext|> 123\n\n x ", "", None, "  \n ", "aaaaaaaaaaaaaaaaaaaaaaaaa", "的日本語ไทย 👍🏽 é", "word" * 4000, "x" * 3001, "\t\xa0​"]
    random.seed(2)
    texts += ["".join(random.choice("abc dé1'\n.") for _ in range(300)) for _ in range(30)]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for r in bpe.encode_corpus(df).collect():
        t = texts[r.doc_id]
        assert list(r.ids) == ref.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_corpus(df.limit(0)).isEmpty()


def test_hot_variants_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(variants, "BATCH_ROWS", 7)
    monkeypatch.setattr(variants, "RANGE_ROWS", 5)
    rows = [(k, "Same  form!" if k % 3 else f"own {k}") for k in range(200)] + [(300, None), (None, "same form"), (1, "same form")]
    df = spark.createDataFrame(rows, "id bigint, x string").repartition(5)
    got = {(r.keep_id, r.dup_id) for r in variants.variant_groups([(df, "t", "id", variants.words(F.col("x")))]).collect()}
    same = [k for k in range(200) if k % 3]
    assert got == {(1, k) for k in same[1:]}


def test_filters_lose_no_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, 5000)
    f = variants.OnceTwice(10)
    f.add(h[:3000])
    f.add(h[2500:])
    assert f.may_repeat(h[2500:3000]).all()
    g = variants.OnceTwice(5500)
    g.add(h)
    assert g.may_repeat(h).mean() < 0.05


def test_seen_in_order_of_arrival_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(seen, "BATCH_ROWS", 16)
    rows = [(k, f"k{k % 37}") for k in range(300)] + [(5, "k5"), (5, "k5"), (400, None)]
    df = spark.createDataFrame(rows, "id bigint, x string").repartition(6)
    got = sorted(r.rec_id for r in seen.seen_before(df, "t", "id", "x").collect())
    assert got == list(range(37, 300))
