"""Keys of very unequal size: nulls, ties, repeated rows, empty tables, clashing names."""

from collections import Counter

from gossamer.operators import skew


def edges(spark):
    rows = [(k, 1, k) for k in range(400)] + [(k, 2 + k % 50, k) for k in range(300)] + [(None, 1, 0), (5, None, 0)] * 3
    return spark.createDataFrame(rows, "from_id bigint, to_id bigint, key bigint")


def test_heavy_hitters(spark):
    e = edges(spark)
    rows = [tuple(r) for r in e.collect()]
    got = {(r.side, r.key, r.n) for r in skew.heavy_hitters(e, ["from_id", "to_id"], 0.01).collect()}
    want = {(c, k, n) for c, i in (("from_id", 0), ("to_id", 1)) for k, n in Counter(r[i] for r in rows).items() if k is not None and n > 0.01 * len(rows)}
    assert got == want
    assert skew.heavy_hitters(e.limit(0), ["from_id"], 0.01).isEmpty()


def test_skew_join(spark):
    e = edges(spark)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(1, 30)], "to_id bigint, name string")
    for how in ("inner", "left"):
        a = sorted(map(str, skew.skew_join(e, right, "to_id", how).select("to_id", "from_id", "name").collect()))
        b = sorted(map(str, e.join(right, "to_id", how).select("to_id", "from_id", "name").collect()))
        assert a == b


def test_lists_and_degrees(spark):
    e = edges(spark)
    rows = [tuple(r) for r in e.collect()]
    got: dict = {}
    for r in skew.chunked_lists(e, "to_id", "from_id", 0.1, 8).collect():
        assert list(r["values"]) == sorted(set(r["values"]))
        got.setdefault(r.to_id, []).extend(r["values"])
    want: dict = {}
    for f, t, _ in rows:
        if f is not None and t is not None:
            want.setdefault(t, set()).add(f)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    deg = {r.key_id: (r.out_degree, r.in_degree) for r in skew.degrees(e).collect()}
    assert deg[1] == (2, 403) and None not in deg
    assert skew.degrees(e.limit(0)).isEmpty() and skew.chunked_lists(e.limit(0), "to_id", "from_id").isEmpty()
