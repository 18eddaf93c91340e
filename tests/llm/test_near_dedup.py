import random

import numpy as np
import pytest

from provspark.llm import near_dedup as N
from provspark.llm.components import connected_components

from .fixtures import corpus, empty, frame, words


def shingle_bag(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute_classes(rows):
    texts = {}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for i, t in rows:
        key = tuple(words(t)) or ("bytes", t or "")
        if key in texts:
            join(texts[key], i)
        texts.setdefault(key, i)
    bags = {i: shingle_bag(" ".join(k)) for k, i in texts.items() if k[0] != "bytes"}
    ids = sorted(bags)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = bags[i], bags[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                m = lcs(a, b)
                if m / (len(a) + len(b) - m) >= 0.8:
                    join(i, j)
    return {i: find(i) for i, _ in rows}


def test_classes_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Buckets of several blocks: bounds and leaders lose no link."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("main", [1, 350, 399])
def test_large_buckets_are_dealt_in_less_than_squares(spark, monkeypatch, main):
    """Members of different labels are paired in exactly one group, groups are small, rows grow far less than with the blocks."""
    monkeypatch.setattr(N, "BLOCK", 8)
    n = 400
    members = [(7, 1000 + i, 0 if i < main else i, 50, n) for i in range(n)] + [(8, i, i, 50, 16) for i in range(16)]
    rows = N._dealt(spark.createDataFrame(members, "bucket long, v long, label long, size int, n int")).collect()
    assert sum(r["bucket"] == 8 for r in rows) == 16
    assert sum(r["bucket"] == 7 for r in rows) <= n * {1: 12, 350: 12, 399: 1.13}[main] < n * n / N.BLOCK
    groups, met = {}, {}
    for r in rows:
        groups.setdefault((r["bucket"], r["low"], r["high"]), []).append(r)
    assert max(map(len, groups.values())) <= 12 * N.BLOCK
    for (_, low, high), group in groups.items():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if a["label"] != b["label"] and (low == high or a["home"] != b["home"]):
                    pair = (min(a["v"], b["v"]), max(a["v"], b["v"]))
                    met[pair] = met.get(pair, 0) + 1
    assert set(met.values()) == {1}
    label = {v: k for _, v, k, _, _ in members}
    assert len(met) == sum(label[1000 + i] != label[1000 + j] for i in range(n) for j in range(i)) + 16 * 15 // 2


def test_members_without_a_partner_are_done_after_the_forest():
    """Of three connected and one unlike member, only those with a possible partner go on; a bounded search keeps a forest."""
    import pyarrow as pa

    seqs = [np.arange(100), np.arange(1, 101), np.arange(2, 102), np.arange(50_000, 50_100)]
    batch = pa.record_batch({"v": pa.array(range(4)), "seq": pa.array([(x * 40_000_003).astype(np.uint32).tobytes() for x in seqs], pa.binary())})
    profile = pa.Table.from_batches(N._profiles([batch])).column("profile")
    table = pa.table({"bucket": [9] * 4, "low": [0] * 4, "high": [0] * 4, "v": range(4), "label": range(4), "size": pa.array([100] * 4, pa.int32()), "home": [0] * 4, "profile": profile})
    rows = N._bounded_pairs(table, True).to_pylist()
    assert len([r for r in rows if r["b"] is not None]) == 2
    assert sorted(r["a"] for r in rows if r["b"] is None) == [0, 1, 2] and {r["bucket"] for r in rows if r["b"] is None} == {9}
    assert N._bounded_pairs(table).num_rows == 3
    held, N.HELD_PAIRS = N.HELD_PAIRS, 0
    try:
        assert N._bounded_pairs(table, True).num_rows == 5
    finally:
        N.HELD_PAIRS = held


def test_repeated_rows_and_nulls(spark):
    rows = [(5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (3, "A, b c d e f g h i j k l!"), (None, "q r s"), (9, None), (8, "")]
    got = sorted((r["class_id"], r["doc_id"]) for r in N.near_duplicates(frame(spark, rows)).collect() if r["doc_id"] in (3, 5, 8, 9))
    assert got == [(3, 3), (3, 5), (3, 5), (8, 8), (8, 9)]


def test_empty_table(spark):
    assert N.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 30, 120).astype(np.uint32)
    b = np.delete(a, rng.integers(0, 120, 6))
    b[rng.integers(0, len(b), 4)] = 99
    full = lcs(a.tolist(), b.tolist())
    assert N.common_subsequence(a, b, full) == full
    assert N.common_subsequence(a, b, full + 1) == -1
    assert N.common_subsequence(a, b, 5) == full


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(1, 5), (5, 3), (40, 2)], "a long, b long")
    got = {r["v"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 31)}, 1: 1, 5: 1, 3: 1, 40: 2, 2: 2}


def test_two_texts_under_one_id(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows = [(1, " ".join(base)), (1, "quite another text without any likeness to the first"), (2, " ".join(base) + " more"), ("x", "z")][:3]
    got = sorted((r["doc_id"], r["class_id"]) for r in N.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1), (1, 1), (2, 1)]
    keys = {r["class_key"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert len(keys) == 2


def test_ids_of_any_type(spark):
    text = "a b c d e f g h i j k l m n"
    df = spark.createDataFrame([("b", text), ("a", text), (None, text + " o"), (None, "alone here")], "doc_id string, text string")
    got = [(r["doc_id"], r["class_id"]) for r in N.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([("b", "a"), ("a", "a"), (None, "a"), (None, None)], key=str)


def test_short_texts_miss_nothing(spark):
    """8 words against the same with one more: similarity 0.8 exactly, where bands miss 1 in 90."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        w = [f"s{rng.randrange(10**7)}" for _ in range(8)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "end"] if i % 2 else ["begin", *w]))]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert all(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(300))


def test_prefix_groups_of_large_buckets(spark, monkeypatch):
    """A common passage fills buckets with documents that are not alike; a few pairs among them are."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(6)
    prose = lambda k: [f"p{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = prose(60), []
    for i in range(80):
        rows.append((i, " ".join(prose(22) + passage + prose(22))))
    for i in range(0, 80, 9):
        w = rows[i][1].split()
        w[3] = "changed"
        rows.append((1000 + i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    from pyspark.sql import functions as F

    large = spark.createDataFrame([(1, r, r, 100) for r in range(3)], "bucket long, v long, label long, size int")
    seq = lambda x: np.array(x, np.uint32).tobytes()
    common = list(range(50))
    sequences = spark.createDataFrame([(0, seq([*common, *range(100, 150)])), (1, seq([*common, *range(100, 149), 7_000])), (2, seq([*common, *range(300, 350)]))], "v long, seq binary")
    groups = N._prefix_groups(large, sequences).groupBy("bucket").agg(F.collect_set("v").alias("vs")).collect()
    assert any({0, 1} <= set(g["vs"]) for g in groups)


def test_profiles_of_long_repetitive_texts():
    """66,000 against 65,500 equal shingles: counters must not wrap."""
    import pyarrow as pa

    a, b = np.full(66_000, 5, np.uint32), np.full(65_500, 5, np.uint32)
    batch = pa.record_batch({"v": pa.array([1, 2]), "seq": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
    profiles = pa.Table.from_batches(N._profiles([batch]))
    table = pa.table({"low": [0, 0], "high": [0, 0], "v": [1, 2], "label": [1, 2], "size": [66_000, 65_500], "home": [0, 0], "profile": profiles.column("profile")})
    assert N._bounded_pairs(table).num_rows == 1
    assert N.similar(a, b) > 0.99


def test_long_texts_by_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.permutation(200_000).astype(np.uint32)
    b = np.delete(a, rng.integers(0, len(a), 15_000))
    assert N.similar(a, b) >= 0.8
    small = a[:400]
    assert N.ordered_common(small, np.delete(small, [5, 90])) == lcs(small.tolist(), np.delete(small, [5, 90]).tolist())


def test_words_of_one_pattern_differ():
    """Thue-Morse words over two letters collide under every polynomial hash modulo 2^64."""
    from provspark.llm import kernels as K

    bits = [bin(i).count("1") & 1 for i in range(2048)]
    x, y = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    words = K.find_words(data, np.array([0, len(data)]), K.ALNUM)
    assert words.hashes[0] != words.hashes[1] and words.hashes[0] == words.hashes[2]
    values = np.array([3, 9], np.uint64)
    one, two = (np.array([values[b ^ f] for b in bits]) for f in (0, 1))
    keys = K.sequence_keys(np.concatenate([one, two, one]), np.array([0, 2048, 4096, 6144]))[0]
    assert keys[0] != keys[1] and keys[0] == keys[2]


def test_tables_are_deleted(spark, tmp_path):
    import os

    from provspark.llm.shared import release

    folder = os.path.join(spark.conf.get("spark.checkpoint.dir"), "provspark")
    release(spark)
    N.near_duplicates(frame(spark, corpus())).count()
    assert len(os.listdir(folder)) == 3
    release(spark)
    assert os.listdir(folder) == []


def test_spanning_forest_connects_what_all_edges_connect():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (30, 20), (40, 400)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        component, strength = rng.integers(0, n, n), rng.integers(0, 5, m) / 5
        kept = N.spanning_forest(a, b, strength, component)

        def components(edges):
            own = component.copy()
            for i in edges:
                own[own == own[a[i]]] = own[b[i]]
            return len(np.unique(own))

        assert components(kept) == components(range(m))
        assert len(kept) == len(np.unique(component)) - components(range(m))


def test_components_of_few_edges_take_one_task(spark, monkeypatch):
    from provspark.llm import components

    rng = np.random.default_rng(4)
    chain = [(-i, -i - 1) for i in range(1, 40)]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + chain + [(7, 7), (1 << 62, -(1 << 62))]
    least = {v: v for e in edges for v in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(components, "materialize", lambda d, name: written.append(name) or materialize(d, name))
    materialize = components.drop_table.__globals__["materialize"]
    assert dict(map(tuple, components.connected_components(df).collect())) == least
    assert written == ["labels"]
    assert components.connected_components(df.limit(0)).count() == 0
    monkeypatch.setattr(components, "IN_ONE_TASK", 0)
    assert dict(map(tuple, components.connected_components(df).collect())) == least
    assert written.count("edges") == 1
