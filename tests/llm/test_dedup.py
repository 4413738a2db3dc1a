"""Exact and near dedup against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotframe.llm import exact_dedup, simhash
from slotframe.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, h string, t string, kept boolean, fp long, _k long"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "s", "h", "t", False, 7, 8) for i, t in rows], SCHEMA)


ROWS = [
    (5, "a  b"), (3, "a b"), (9, "a\t\nb"), (4, "a b "), (1, None), (2, ""), (None, "a b"), (None, "only null id"), (None, None),
    (7, "same"), (7, "same"), (8, "x" * 200_000), (10, "x" * 200_000 + " "), (11, "  "), (12, "\u00a0"), (13, "é"), (14, "e\u0301"),
]


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, ROWS)).collect()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    assert len(got) == len(ROWS)
    want = sorted(((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_of_nothing_and_dropping(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []
    left = exact_dedup.drop_exact_copies(docs(spark, ROWS))
    assert left.columns == docs(spark, []).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, i) for i in (1, 3, 4, 7, 8, 10, 11, 12, 13, 14)] + [(True, 0)]


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    """With digests that always collide, the bytes decide."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.lit("11"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_texts_of_one_md5_stay_apart(spark, monkeypatch):
    """With a 128-bit hash that always collides, the comparison of bytes finds it out and the other digest decides."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00"))
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c")])).collect())
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 1, True)]


def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[top(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min((x for x in groups[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    r = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "İ ſ É"), (8, "a b c " * 20_000)]
    for i in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randrange(40, 400))]
        rows.append((100 + 10 * i, " ".join(base)))
        for k in range(1, r.randrange(1, 5)):
            near = list(base)
            for _ in range(r.randrange(0, 3)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            rows.append((100 + 10 * i + k, "  ".join(near).upper() if k == 2 else " ".join(near)))
    return rows


def test_near_copies_against_all_pairs(spark):
    rows = near_rows()
    got = simhash.near_copies(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_near_copies_of_nothing_and_dropping(spark):
    assert simhash.near_copies(docs(spark, [])).collect() == []
    rows = [r for r in near_rows() if r[0] is not None]
    left = {r["doc_id"] for r in simhash.drop_near_copies(docs(spark, rows)).collect()}
    assert left == {c for *_, c in brute_components(rows)}


def test_dropping_with_null_and_repeated_ids(spark):
    """Every component keeps exactly one row, whatever ids its rows have."""
    unlike = lambda i: " ".join(f"u{i}w{k}" for k in range(200))
    assert simhash.drop_near_copies(docs(spark, [(None, unlike(i)) for i in range(20)])).count() == 20
    near = unlike(3) + " more"
    rows = [(3, unlike(3)), (5, near), (5, unlike(5)), (5, unlike(6)), (6, unlike(6)), (7, unlike(7)), (7, unlike(7)), (None, unlike(7)), (None, unlike(8)), (None, None), (None, "")]
    assert (slow_fingerprint(near) ^ slow_fingerprint(unlike(3))).bit_count() <= 3
    left = [(r["doc_id"], r["text"] or "") for r in simhash.drop_near_copies(docs(spark, rows)).collect()]
    assert sorted(left, key=str) == sorted([(3, unlike(3)), (5, unlike(5)), (5, unlike(6)), (7, unlike(7)), (None, unlike(8)), (None, "")], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_pairs(seed):
    g = np.random.default_rng(seed)
    base = g.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [base]
    for _ in range(12):
        flips = np.zeros(40, np.uint64)
        for _ in range(3):
            flips ^= np.uint64(1) << g.integers(0, 64, 40).astype(np.uint64)
        fps.append(base ^ flips)
    fp = np.unique(np.concatenate(fps))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    cuts = sorted(g.integers(0, len(fp), 2))
    trees = [simhash.GrayTree(x) for x in np.split(fp, cuts)]
    search, got = simhash.Search(3), set()
    for i, a in enumerate(trees):
        for b in trees[i:]:
            for x, y in search.near(a, b):
                pairs = [frozenset((int(a.values[0][p]), int(b.values[0][q]))) for p, q in zip(x, y)]
                assert len(set(pairs)) == len(pairs) and not got & set(pairs)
                got |= set(pairs)
    want = {frozenset((int(fp[i]), int(fp[j]))) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3}
    assert got == want


def test_index_leaves_whole_groups():
    """Of all pairs of random fingerprints only a small part is ever compared, as groups are left on the way."""
    g = np.random.default_rng(1)
    fp = np.unique(g.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + g.integers(0, 2, 20_000, dtype=np.uint64))
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    search = simhash.Search(3)
    assert sum(len(x) for x, _ in search.near(simhash.GrayTree(fp), simhash.GrayTree(fp[:1]))) == 1
    search = simhash.Search(3)
    tree = simhash.GrayTree(fp)
    assert not [x for x, _ in search.near(tree, tree)]
    pairs = len(fp) * (len(fp) - 1) // 2
    print(f"{search.left} pairs of groups left, {search.compared} compared, {pairs} pairs in all")
    assert search.left > 100_000 and search.compared < pairs / 4


def test_blocks_are_in_gray_order(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)
    g = np.random.default_rng(2)
    fp = g.integers(-(1 << 63), (1 << 63) - 1, 1000)
    blocks = simhash.write_blocks(spark.createDataFrame([(int(x),) for x in fp], "fp long"))
    read = [blocks.read(i) for i in range(len(blocks.names))]
    assert len(read) >= 10 and max(map(len, read)) <= 100
    every = np.concatenate(read)
    assert (every == np.array(sorted(fp.view(np.uint64).tolist(), key=lambda x: int(simhash.gray_rank(np.array([x], np.uint64))[0])), np.uint64)).all()
    near = {(i, int(j)) for i in range(len(read)) for j in blocks.near(i, 64)}
    assert {frozenset(p) for p in near} == {frozenset((i, j)) for i in range(len(read)) for j in range(i + 1)} and len(near) == len(read) * (len(read) + 1) // 2


def test_all_links_survive_the_blocks(spark, monkeypatch):
    """Pairs at every distance up to 3 meet, wherever the bits differ."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(100)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), 3)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.linked_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    for a in signed:
        for b in signed:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                assert roots[a] == roots[b]


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5000, 5000)]
    star = [(2000, 2001 + i) for i in range(200)]
    r = random.Random(1)
    edges = chain + star
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000, **{i: 2000 for i in range(2000, 2201)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
