"""Mixing against targets worked out by hand, and the permutation against its definition."""

import re

import pytest
from pyspark.sql import functions as F

from slotframe.llm import mixing
from slotframe.llm.mixing import Mix

SCHEMA = "doc_id long, text string, source string, size long, target double, rank int, block_index long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 1.0, 1, 1) for i, t, s in rows], SCHEMA)


def targets(sizes, mix):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    cap = {s: mix.cap * sizes[s] for s in names}
    out, left, free = {}, mix.share * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap[s]}
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        free -= over
    return out


def rows():
    out = []
    for k, (source, n, words) in enumerate([("b", 40, 300), ("a", 5, 20), (None, 30, 100), ("é", 200, 50), ("Z", 3, 4000), ("one", 1, 1), ("void", 4, 0)]):
        out += [(1000 * k + 1000 + i, " ".join(["w"] * (words + i % 3 * (words > 1))), source) for i in range(n)]
    return out + [(None, "x y z", "b"), (None, None, "b"), (7, "p q", "b"), (7, "p q", "b"), (8, None, None)]


def test_mix(spark):
    data = rows()
    got = mixing.mix_sources(docs(spark, data)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((i, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, _ in data), key=str)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes, Mix())
    source_of = {i: s for i, _, s in data if i not in (None, 7, 8)}
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] in source_of:
            s = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
            taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 30 + 0.02 * want[s], s
    again = mixing.mix_sources(docs(spark, data[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    (only,) = mixing.mix_sources(docs(spark, [(1, None, None)])).collect()
    assert (only["size"], only["source_size"], only["target"], only["taken"]) == (0, 0, 0.0, 0)


def test_slots_draw_and_permute(spark):
    data = [(i, "w " * 500, "ab"[i % 2]) for i in range(200)]
    mix = Mix(block_words=100, shard_slots=64)
    sized = docs(spark, data).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized, mix)
    slots = mixing.mix_slots(plan, mix).collect()
    for p in plan.collect():
        own = sorted((s["slot"], s["block_index"]) for s in slots if s["rank"] == p["rank"])
        assert [k for k, _ in own] == list(range(p["n_slots"]))
        first = [b for _, b in own[: p["n_blocks"]]]
        assert len(set(first)) == len(first) and all(0 <= b < p["n_blocks"] for b in first)
        assert first != sorted(first)
    drawn = {}
    for s in slots:
        drawn.setdefault(s["shard"], set()).add(s["rank"])
    assert sum(len(v) == 2 for v in drawn.values()) > len(drawn) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5), 24)).collect()
    assert sorted(x[0] for x in got) == list(range(n))


def test_mixed_documents(spark):
    data = [r for r in rows() if r[0] is not None and r[0] not in (7, 8)]
    frame = docs(spark, data)
    got = mixing.mixed_documents(frame)
    assert got.columns == frame.columns
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_sources(frame).collect()}
    times = {}
    for r in got.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    for i, (t, size) in taken.items():
        assert times.get(i, 0) in ((0,) if not t else (t // size, -(-t // size)))


SMALL = Mix(block_words=40, shard_slots=16)


def named_rows():
    """Each word tells its row."""
    out = [(i, [f"r{n}" for _ in range(size)], s) for n, (i, size, s) in enumerate((1000 * k + j, 5 + (j * 37) % 200, s) for k, s in enumerate(["a", "b", None]) for j in range(60 // (k + 1)))]
    more = [(5, 30, "a"), (5, 30, "a"), (5, 31, "a"), (None, 12, "b"), (None, 12, "b"), (None, 0, "b"), (77, 0, None)]
    out += [(i, [f"m{n}" for _ in range(size)], s) for n, (i, size, s) in enumerate(more)]
    return [(i, "\t \n".join(w), s) for i, w, s in out]


def test_taken_against_naive_blocks_and_slots(spark):
    """Lay the words of each source end to end, cut them at every block, and count what the slots take."""
    data = named_rows()
    sized = docs(spark, data).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    plan = mixing.source_plan(sized, SMALL)
    slots = mixing.mix_slots(plan, SMALL).collect()
    n_chunks = max(1, -(-len(data) // mixing.CHUNK_DOCS))
    lines = sized.withColumn("chunk", F.pmod(F.xxhash64(F.lit(SMALL.seed), "doc_id", "size"), F.lit(n_chunks))).collect()
    want = []
    for p in plan.collect():
        own = sorted((r for r in lines if r["source"] == p["source"]), key=lambda r: (r["chunk"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        laid = [n for n, r in enumerate(own) for _ in range(r["size"])]
        taken = [0] * len(own)
        for s in slots:
            if s["rank"] == p["rank"]:
                for n in laid[s["block_index"] * p["block"] : (s["block_index"] + 1) * p["block"]]:
                    taken[n] += 1
        want += [(r["doc_id"], r["size"], t) for r, t in zip(own, taken)]
    got = [(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_sources(docs(spark, data), SMALL).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_the_mix_itself(spark):
    data = named_rows()
    got = mixing.mixed_blocks(docs(spark, data), SMALL).collect()
    sized = docs(spark, data).select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    plan = {p["source"]: p for p in mixing.source_plan(sized, SMALL).collect()}
    times, sources = {}, {}
    for r in got:
        found = r["text"].split(" ")
        assert len(found) == r["n_words"] <= plan[r["source"]]["block"]
        sources[r["source"]] = sources.get(r["source"], 0) + 1
        for w in found:
            times[w] = times.get(w, 0) + 1
    assert sources == {s: p["n_slots"] for s, p in plan.items()}
    assert all(p["n_blocks"] > 1 for p in plan.values())
    names = {i: t.split()[0] for i, t, _ in data if t and i not in (5, None)}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs(spark, data), SMALL).collect()}
    assert all(times.get(w, 0) == taken[i] for i, w in names.items())
    assert mixing.mixed_blocks(docs(spark, [(1, None, None)]), SMALL).collect() == []


def test_mixed_documents_tells_rows_apart(spark):
    """Null and repeated ids with different texts of one length each come as often as their own text is taken."""
    data = [(i % 3 or None, f"w{i} " * 40, "a") for i in range(120)]
    times = {}
    for r in mixing.mixed_documents(docs(spark, data), SMALL).collect():
        times[r["text"]] = times.get(r["text"], 0) + 1
    sized = mixing._sized(docs(spark, data), mixing.text_key(F.col("text")).alias("key"))
    taken = {bytes(r["key"]): r["taken"] for r in mixing._taken(sized, SMALL, "key").collect()}
    import hashlib

    for _, t, _ in data:
        of = taken[hashlib.sha256(t.encode()).digest()]
        assert of // 40 <= times.get(t, 0) <= -(-of // 40)
