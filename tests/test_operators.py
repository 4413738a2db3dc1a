"""Operators on small tables against naive models."""

import random

import pytest

from pyspark.sql import functions as F

from slotframe.operators import bloom, graph, intervals, jobs, keys, log, recycle
from slotframe.streaming import tail


def test_running_total_crosses_chunks(spark):
    rows = [(i, i % 5) for i in range(1000)]
    got = log.running_total(spark.createDataFrame(rows, "seq long, v long"), "seq", "v", "s", chunk=64).orderBy("seq").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total
    before = log.predecessor(spark.createDataFrame(rows, "seq long, v long"), "seq", "v", "p", first=-1, chunk=64).orderBy("seq").collect()
    assert [r["p"] for r in before] == [-1] + [v for _, v in rows[:-1]]


def test_empty_log(spark):
    empty = spark.createDataFrame([], "seq long, kind string, kind_tag int, user_id long, body string, body_size long")
    assert log.frame(empty).count() == 0
    assert log.bounds(empty).first().asDict() == {"trim_pos": 0, "flush_pos": 0, "commit_pos": 0}
    assert jobs.pending(jobs.linked(empty)).count() == 0


def test_unknown_tag_fails(spark):


    bad = spark.createDataFrame([(0, "?", None, 1, "", 1)], "seq long, kind string, kind_tag int, user_id long, body string, body_size long")
    with pytest.raises(Exception, match="kBadPackedVariant"):
        log.by_kind(bad).collect()


@pytest.mark.parametrize("cell", [4, 4096])
def test_interval_map_against_dense(spark, cell):
    r = random.Random(13)
    updates, size = [], 29
    dense = {k: [0] * size for k in range(5)}
    for _ in range(300):
        k, lo = r.randrange(5), r.randrange(size)
        hi, slot = r.randrange(lo + 1, size + 1), r.randrange(1, 30)
        updates.append((k, lo, hi, slot))
        for i in range(lo, hi):
            dense[k][i] = max(dense[k][i], slot)
    runs = intervals.runs(spark.createDataFrame(updates, "map_key long, lo long, hi long, slot long"), cell)
    got = {k: [0] * size for k in range(5)}
    for x in runs.collect():
        for i in range(x["lo"], x["hi"]):
            got[x["map_key"]][i] = x["slot"]
    assert got == dense
    ordered = sorted((x["map_key"], x["lo"], x["hi"], x["slot"]) for x in runs.collect())
    assert all(not (a[0] == b[0] and a[2] == b[1] and a[3] == b[3]) for a, b in zip(ordered, ordered[1:]))


def test_interval_merge_case(spark):
    runs = intervals.runs(spark.createDataFrame([(0, 1, 3, 1), (0, 0, 2, 1)], "map_key long, lo long, hi long, slot long")).collect()
    assert [tuple(x) for x in runs] == [(0, 0, 3, 1)]


def test_interval_pieces(spark):
    cases = [((0, 10), (3, 5), [(0, 3), (5, 10)]), ((0, 10), (0, 10), []), ((0, 10), (10, 12), [(0, 10)]), ((0, 10), (4, 4), [(0, 10)]), ((5, 5), (1, 9), []), ((0, 10), (5, 20), [(0, 5)])]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], "a long, b long, c long, d long")
    got = df.select(intervals.without(*map(F.col, "abcd"))).collect()
    assert [[tuple(p) for p in x[0]] for x in got] == [want for *_, want in cases]


def test_traversal_against_search(spark):
    r = random.Random(100)
    edges = [(i, j) for i in range(1, 41) for j in range(i + 1, 41) if r.random() < 0.1]
    targets = {j for _, j in edges}
    roots = [i for i in range(1, 41) if i not in targets][:3]
    seen, stack = set(roots), list(roots)
    while stack:
        n = stack.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                stack.append(b)
    e = spark.createDataFrame(edges, "src long, dst long")
    top = spark.createDataFrame([(x,) for x in roots], "page_id long")
    assert {x["page_id"] for x in graph.reach(e, top).collect()} == seen
    assert {tuple(x) for x in graph.trace(e, top).select("src", "dst").collect()} == {(a, b) for a, b in edges if a in seen}
    new = spark.range(1, 45).select(F.col("id").alias("page_id"))
    assert {x[0] for x in graph.unreachable(new, top, e).collect()} == set(range(1, 45)) - seen


def test_traversal_of_a_cycle_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert graph.reach(e, spark.createDataFrame([(1,)], "page_id long")).count() == 3


def test_cascade(spark):
    edges = [(1, 10), (2, 10), (10, 20), (3, 30), (9, 30)]
    e = spark.createDataFrame(edges, "src long, dst long")
    counts = e.groupBy(F.col("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("refs"))
    dead = spark.createDataFrame([(1,), (2,), (3,)], "page_id long")
    assert {tuple(x) for x in graph.cascade(counts, dead, e).select("page_id", "depth").collect()} == {(1, 0), (2, 0), (3, 0), (10, 1), (20, 2)}


def test_deltas(spark):
    p = lambda *ids: spark.createDataFrame([(i,) for i in ids], "page_id long")
    edges = spark.createDataFrame([(1, 2), (2, 5), (3, 5), (9, 6), (9, 2)], "src long, dst long")
    got = {tuple(x) for x in graph.deltas(p(1, 2, 3), p(1), p(7), p(9), edges).collect()}
    # page 3 is new but no root leads to it; page 2 gains itself and a reference and loses one of page 9
    assert got == {(1, 2), (2, 1), (5, 1), (6, -1), (7, -1), (9, graph.DROP)}


def test_exactly_once_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.randrange(6), r.randrange(60), True) for i in range(300)]
    df = spark.createDataFrame(rows, "arrival long, client long, user_slot long, attached boolean")
    last, want = {}, set()
    for i, c, s, _ in rows:
        if s > last.get(c, -1):
            want.add(i)
            last[c] = s
    assert {x["arrival"] for x in jobs.exactly_once(df).filter("status = 'applied'").collect()} == want
    source = str(tmp_path / "in")
    for part in range(3):  # three batches, so the state is carried over
        df.filter(F.floor(F.col("arrival") / 100) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assert {x["arrival"] for x in tail.drain(tail.exactly_once(stream.select("arrival", "client", "user_slot"))).collect()} == want


def test_replaying_twice_changes_nothing(spark):
    rows = [(0, "upsert", 1, "a"), (1, "remove", 1, None), (2, "upsert", 2, "b"), (3, "upsert", 2, "c")]
    df = spark.createDataFrame(rows, "seq long, op string, key long, value string")
    once, twice = jobs.kv_replay(df).collect(), jobs.kv_replay(df.unionByName(df)).collect()
    assert [tuple(x) for x in once] == [tuple(x) for x in twice] == [(2, "c")]


def test_recycling(spark):
    rows = [(1, 0, 5, None), (1, 2, 9, None), (2, 2, 6, None), (3, 1, 7, None), (4, 2, 8, 40)]
    df = spark.createDataFrame(rows, "page_id long, depth int, slot long, batch_slot long")
    waiting = recycle.pending(df)
    assert {x["page_id"] for x in waiting.collect()} == {1, 2, 3}
    assert [x["page_id"] for x in recycle.batch(waiting, 1).collect()] == [1]
    assert recycle.in_flight(df, spark.createDataFrame([(40,)], "batch_slot long")).count() == 0


def test_key_lookup(spark):
    names = ["a", "aa", "ab", "b", "b", None]
    k = spark.createDataFrame([(x,) for x in names], "key string")
    probes = spark.createDataFrame([("a",), ("ac",), ("",), ("z",)], "probe string")
    assert {tuple(x) for x in keys.find(k, probes).collect()} == {("a", 0, 1), ("ac", 3, 3), ("", 0, 0), ("z", 4, 4)}
    assert [x["key"] for x in keys.ranked(k).orderBy("i").collect()] == ["a", "aa", "ab", "b"]
    pairs = spark.createDataFrame([("a", "a"), ("aa", "a"), ("a", "aa"), ("ab", "aa"), ("aa", "ab")], "a string, b string")
    assert [x[0] for x in pairs.select(keys.compare(F.col("a"), F.col("b"))).collect()] == [0, 1, -1, 1, -1]
    assert [x[0] for x in pairs.select(keys.common_prefix(F.col("a"), F.col("b"))).collect()] == ["a", "a", "a", "a", "a"]


def test_bloom_semi_join(spark):
    probes = spark.createDataFrame([(str(i),) for i in range(200)], "item string")
    members = spark.createDataFrame([(str(i),) for i in range(0, 300, 7)], "item string")
    for layout in bloom.LAYOUTS:
        got = bloom.semi_join(probes, members, bloom.Config.for_keys(layout, 43, 10.0)).collect()
        assert {int(x["item"]) for x in got} == set(range(0, 200, 7))


def test_log_bytes(spark, tmp_path):
    from slotframe.sources import raw_log

    data = bytes([3, 8]) + b"ab" + bytes([0]) + bytes([0x82, 0x00, 5]) + b"c" + bytes([9, 4]) + b"cut"
    assert list(raw_log.parse_segment(data, 100)) == [(100, 104, 1, 8, b"ab"), (105, 109, 2, 5, b"c")]
    assert list(raw_log.parse_segment(b"", 0)) == [] and list(raw_log.parse_segment(b"\x80\x80", 0)) == []
    rows = [(i, "raw", 8, 1, "x" * (i * 7 % 300), 1 + i * 7 % 300) for i in range(50)]
    framed = log.frame(spark.createDataFrame(rows, "seq long, kind string, kind_tag int, user_id long, body string, body_size long"))
    segments = raw_log.pack(framed, segment=16)
    for r in segments.collect():
        (tmp_path / f"{r['base']}.log").write_bytes(bytes(r["data"]))
    got = raw_log.parse(raw_log.read_segments(spark, str(tmp_path))).orderBy("slot_lower").collect()
    want = framed.orderBy("seq").collect()
    assert [(r["slot_lower"], r["slot_upper"], r["header_size"], bytes(r["payload"]).decode()) for r in got] == [(r["slot_lower"], r["slot_upper"], r["header_size"], r["body"]) for r in want]


def test_traversals_have_no_depth_bound(spark):
    n = 36
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").coalesce(1)
    p = lambda ids: spark.createDataFrame([(i,) for i in ids], "page_id long").coalesce(1)
    assert {tuple(x) for x in graph.reach(e, p([0])).collect()} == {(i, i) for i in range(n + 1)}
    assert [x[0] for x in graph.unreachable(p([1, n, n + 1]), p([0]), e).collect()] == [n + 1]


def test_deep_chains(spark):
    """A traversal doesn't stop at the depth that bounds releases; a release that deep raises."""
    n = graph.MAX_DEPTH + 4
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    root = spark.createDataFrame([(0,)], "page_id long")
    assert graph.trace(chain, root).count() == n
    some = sorted(r["dst"] for r in graph.trace(chain, root, recurse=F.col("dst") < 3).collect())
    assert some == [1, 2, 3]
    counts = chain.groupBy(F.col("dst").alias("page_id")).agg(F.count(F.lit(1)).alias("refs"))
    with pytest.raises(RuntimeError, match="deepest"):
        graph.cascade(counts, root, chain, max_depth=3)


def test_codecs_of_nulls(spark):
    from slotframe.functions import codecs

    rows = spark.createDataFrame([(None, None, 1), ("000000000000f03f", "a", 2)], "code string, item string, n int")
    got = rows.select(codecs.double_from_hex("code").alias("x"), codecs.filter_hash("item", "n").alias("h")).collect()
    assert [r["x"] for r in got] == [None, 1.0] and all(r["h"] is not None for r in got)


@pytest.mark.parametrize("open_ended", [False, True])
def test_trim_grants_against_search(spark, open_ended):
    r = random.Random(5)
    lowers = r.sample(range(0, 400), 40)
    locks = [(lo, None if open_ended and i % 10 == 0 else lo + r.randrange(0, 60)) for i, lo in enumerate(lowers)]
    asked = [(at, at + r.randrange(-80, 30)) for at in range(0, 480, 3)]
    want = {(at, t, min([t, *(lo for lo, end in locks if lo <= at and (end is None or end > at))])) for at, t in asked}
    got = jobs.trim_grants(spark.createDataFrame(locks, "lower long, released long"), spark.createDataFrame([*asked, (None, 1)], "at long, target long"))
    assert {tuple(x) for x in got.collect()} == want
    none = spark.createDataFrame([], "lower long, released long")
    assert {tuple(x) for x in jobs.trim_grants(none, spark.createDataFrame(asked, "at long, target long")).collect()} == {(a, t, t) for a, t in asked}


def test_drop_pages(spark):
    pages = spark.createDataFrame([(1, 0), (2, 3), (3, 3), (4, 1), (5, None)], "physical long, generation long")
    drops = spark.createDataFrame([(1, 0), (1, 0), (2, 2), (3, 4), (4, None), (5, 9), (6, 0)], "physical long, generation long")
    once = recycle.drop_pages(pages, drops)
    assert {x["physical"] for x in once.collect()} == {2, 4, 5}
    assert {x["physical"] for x in recycle.drop_pages(once, drops).collect()} == {2, 4, 5}


def test_sort_segments(spark):
    got = log.sort_segments(spark.createDataFrame([(100, 20), (0, 90), (115, 5)], "base long, n_bytes long")).collect()
    assert [tuple(x) for x in got] == [(0, 90, 0), (100, 20, 10), (115, 5, -5)]


def test_latencies(spark):
    linked = spark.createDataFrame([(1, "prepare", 1), (4, "commit", 1), (6, "commit", 1), (7, "rollback", 1)], "seq long, kind string, prepare_slot long")
    times = spark.createDataFrame([(1, 10), (4, 25), (6, 11), (7, None)], "seq long, us long")
    assert {tuple(x) for x in jobs.latencies(linked, times).collect()} == {("commit", 2, 16, 1, 15), ("rollback", 1, None, None, None)}
