"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its words (``[0-9a-z]`` and all beyond ASCII, A-Z
lower-cased) and of its five-word shingles.  Each of ``BANDS`` hash functions
samples the ``SAMPLED`` least occurrence-labelled shingles and keeps them in the
order of the text; documents with an equal sample meet in a bucket.  Short texts
(up to ``SHORT`` shingles), whose bands would miss too often, meet by a prefix
filter instead, which misses nothing: two texts of the similarity share one of
the first fifth of their shingles in any common order.  Documents with equal word
sequences are one vertex from the start, so copies are never expanded.

Buckets are resolved in rounds.  First every document is aligned with a single one
of its buckets' leaders, then every member with the leader of its bucket, and links
join components: a large group of near
copies becomes one component without its pairs being listed.  In buckets that still
span several components the remaining pairs are bounded by shingle profiles (512
counters, whose minima are at least what two texts share), and those that could
reach the similarity are aligned: first a spanning forest of the strongest bounds,
which is linear in a bucket, then, between members that had a possible partner, all
that its links left unconnected.  Members of buckets that are too large to pair
are dealt anew by the prefix filter, frequent shingles last; what is still larger
than a task's share is paired along the lines of a square.  So each pair of a
bucket is aligned, connected already, or proven too different.  Alignment runs on
the shingle sequences inside the diagonal band that the similarity allows: with M
the longest common subsequence, M / (|A| + |B| - M) >= 0.8 is a link.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .shared import drop_table, list_array, mark, materialize, release, slices, text_bytes

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
SAMPLED = 4
#: Shingles up to which a text meets others by the prefix filter; a little beyond, it has bands too.
SHORT = 40
#: Row keys are broadcast up to this many (8 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members that a copy of a leader's sequence serves.
SERVED = 64
#: First and last leader of the rounds before the rest is decided pair by pair, and whether a
#: document tries the least of its buckets' leaders only.
LEADERS = ((0, 1, True), (0, 1, False))
#: Rounds in which a bucket's components are aligned along a spanning forest, before all pairs that remain.
FORESTS = 1
#: Counters of a text's shingle profile, and members of a block that one task pairs with another.
PROFILE = 512
BLOCK = 1024
#: Sides of the squares that larger buckets are dealt onto (primes), and pairs that a forest's search holds at once.
SIDES = [p for p in range(2, 1024) if all(p % d for d in range(2, p))]
HELD_PAIRS = 1 << 20
#: At most this many frequent shingles are put last by the prefix filter of large buckets (8 bytes each, broadcast).
FREQUENT = 50_000
#: Edits from which a lower bound is tried before the exact alignment.
MANY_EDITS = 2_000
_U = np.uint64


def _seeds(bands: int) -> np.ndarray:
    return np.random.default_rng(20_25).integers(0, 1 << 63, (bands, 2), dtype=np.int64).astype(_U) * _U(2) + _U(1)


def order_minhash(labels: np.ndarray, offsets: np.ndarray, bands: int = BANDS, sampled: int = SAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """Band keys [documents x bands] of documents with enough shingles, and their indexes.

    Fewer than ``sampled`` shingles can't reach the similarity with any other
    sequence, so such documents need no bands.
    """
    sizes = np.diff(offsets)
    chosen = np.flatnonzero(sizes >= sampled)
    keys = np.zeros((len(chosen), bands), _U)
    if not len(chosen):
        return keys, chosen
    segments = K.segment_ids(offsets)
    # the least few values of n lie below (a multiple of) 1/n of the range
    limit = np.minimum(float(1 << 64) * 24.0 / np.maximum(sizes, 1), float(2**64 - 2048)).astype(_U)
    limit[sizes < 48] = _U(2**64 - 1)
    limits = np.repeat(limit, sizes)
    limits[~np.isin(segments, chosen)] = 0
    q = _U(0xD6E8FEB86659FD93)
    for n, (odd, salt) in enumerate(_seeds(bands)):
        values = (labels ^ salt) * odd
        picked = np.flatnonzero(values <= limits)
        counts = np.bincount(segments[picked], minlength=len(sizes))
        short = chosen[counts[chosen] < sampled]
        if len(short):
            extra = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in short])
            picked = np.union1d(picked, extra)
            counts = np.bincount(segments[picked], minlength=len(sizes))
        picked = picked[np.isin(segments[picked], chosen)] if (sizes < sampled).any() else picked
        own = segments[picked]
        order = np.lexsort((values[picked], own))
        first = np.concatenate([[0], np.cumsum(counts[chosen])])[:-1]
        rows = np.sort(picked[order[(first[:, None] + np.arange(sampled)).ravel()]]).reshape(-1, sampled)
        key = np.full(len(chosen), n + 1, _U)
        for j in range(sampled):
            key = key * q + labels[rows[:, j]]
        keys[:, n] = K.mix(key)
    return keys, chosen


def prefix_keys(labels: np.ndarray, offsets: np.ndarray, chosen: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first labelled shingles of the chosen documents in a common order, and how many each has.

    With at least 0.8 of either text in common, at most a fifth of a text's
    shingles are not shared, so one more than a fifth holds a shared one.
    ``last`` (sorted) are shingles that come after all others.
    """
    sizes = np.diff(offsets)[chosen]
    where = np.arange(int(sizes.sum())) + np.repeat(offsets[:-1][chosen] - (np.cumsum(sizes) - sizes), sizes)
    own, values = np.repeat(np.arange(len(chosen)), sizes), labels[where]
    if last is not None and len(last):
        late = last[np.minimum(np.searchsorted(last, values), len(last) - 1)] == values
        order = np.lexsort((values, late, own))
    else:
        order = np.lexsort((values, own))
    counts = sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(np.int64) + 1
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return values[order[place < np.repeat(counts, sizes)]], counts


def _shingle_labels(data: np.ndarray, offsets: np.ndarray):
    words = K.find_words(data, offsets, K.ALNUM)
    values, _, cuts = K.shingles(words, WORDS)
    return words, values, cuts


def _labelled(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    occurrence = K.occurrence_labels(values, K.segment_ids(cuts)).astype(_U)
    return K.mix(values + occurrence * _U(0x9E3779B97F4A7C15))


def _content_keys(words: K.Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word sequence; for each text's bytes where it has no words."""
    k1, k2 = (k.astype(np.int64) for k in K.sequence_keys(words.hashes, words.offsets))
    for d in np.flatnonzero(words.counts == 0):
        digest = blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=16).digest()
        k1[d], k2[d] = np.frombuffer(digest, np.int64)
    return k1, k2


def bucket_keys(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of the documents, and how many each has."""
    labels, sizes = _labelled(values, cuts), np.diff(cuts)
    keys, chosen = order_minhash(labels, cuts)
    banded = sizes[chosen] > SHORT
    short = np.flatnonzero((sizes >= SAMPLED) & (sizes <= 1.25 * SHORT))
    prefix, counts = prefix_keys(labels, cuts, short)
    document = np.concatenate([np.repeat(chosen[banded], BANDS), np.repeat(short, counts)])
    flat = np.concatenate([keys[banded].ravel(), K.mix(prefix ^ _U(0x5851F42D4C957F2D))])
    order = np.argsort(document, kind="stable")
    return flat[order], np.bincount(document, minlength=len(sizes))


def _sketch(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            words, values, cuts = _shingle_labels(data, offsets)
            k1, k2 = _content_keys(words, data, offsets)
            keys, counts = bucket_keys(values, cuts)
            buckets = list_array(pa.array(keys.view(np.int64)), np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(k1), pa.array(k2), pa.array(np.diff(cuts).astype(np.int32)), buckets], names=["doc_id", "row_key", "k1", "k2", "size", "buckets"]
            )


def _sequences(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            words, values, cuts = _shingle_labels(data, offsets)
            k1, k2 = _content_keys(words, data, offsets)
            small = values.astype(np.uint32).tobytes()
            out = [small[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(out, pa.binary())], names=["k1", "k2", "seq"])


def common_subsequence(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence if it is at least ``need``, else -1.

    Furthest-reaching points by number of edits, on the diagonals |k| <= edits
    that a result of ``need`` leaves.
    """
    k = min(len(a), len(b))
    if k < need:
        return -1
    differ = a[:k] != b[:k]
    prefix = int(differ.argmax()) if differ.any() else k
    a, b = a[prefix:], b[prefix:]
    k = min(len(a), len(b))
    differ = a[len(a) - k :][::-1] != b[len(b) - k :][::-1]
    suffix = int(differ.argmax()) if differ.any() else k
    a, b = a[: len(a) - suffix], b[: len(b) - suffix]
    base, n, m = prefix + suffix, len(a), len(b)
    if n == 0 or m == 0:
        return base if base >= need else -1
    most = n + m - 2 * max(0, need - base)
    if most < abs(n - m):
        return -1
    reach = np.full(2 * most + 3, -1, np.int64)
    mid = most + 1
    reach[mid + 1] = 0
    for e in range(most + 1):
        low, high = -min(e, m), min(e, n)
        ks = np.arange(low + ((low + e) & 1), high + 1, 2)
        x = np.maximum(reach[mid + ks - 1] + 1, reach[mid + ks + 1])
        y = x - ks
        ok = (x <= n) & (y <= m) & (x >= 0) & (y >= 0)
        x = np.where(ok, x, -1)
        inside = np.flatnonzero(ok & (x < n) & (y < m))
        for i in inside[a[x[inside]] == b[y[inside]]].tolist():
            at_x, at_y, step = int(x[i]), int(y[i]), 32
            while True:
                size = min(step, n - at_x, m - at_y)
                if size == 0:
                    break
                wrong = a[at_x : at_x + size] != b[at_y : at_y + size]
                if wrong.any():
                    at_x += int(wrong.argmax())
                    break
                at_x, at_y, step = at_x + size, at_y + size, step * 2
            x[i] = at_x
        reach[mid + ks] = x
        if ((x == n) & (x - ks == m)).any():
            return base + (n + m - e) // 2
    return -1


def ordered_common(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the longest common subsequence: the longest run in order of the values that both have once."""
    once = lambda x: (lambda v, i, n: (v[n == 1], i[n == 1]))(*np.unique(x, return_index=True, return_counts=True))
    (va, ia), (vb, ib) = once(a), once(b)
    _, x, y = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    tails: list[int] = []
    for at in ib[y][np.argsort(ia[x])].tolist():
        n = bisect_left(tails, at)
        if n == len(tails):
            tails.append(at)
        else:
            tails[n] = at
    return len(tails)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Alignment similarity (of very long texts a lower bound) if it reaches the threshold, else 0."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    need = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    # a bag of common shingles bounds every alignment
    values, counts = np.unique(a, return_counts=True)
    at = np.searchsorted(values, b)
    at[at == len(values)] = 0
    hit = np.bincount(at[values[at] == b], minlength=len(values))
    if np.minimum(hit, counts).sum() < need:
        return 0.0
    if total - 2 * need > MANY_EDITS and (common := ordered_common(a, b)) >= need:
        return common / (total - common)
    common = common_subsequence(a, b, need)
    return common / (total - common) if common >= need else 0.0


def _align(batches):
    for batch in batches:
        left, right = batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist()
        score = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(left, right)]
        out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], names=["a", "b", "similarity"])
        yield out.filter(pa.array([s > 0 for s in score], pa.bool_()))


def _links(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Those of pairs(a, b, salts) that reach the similarity; a is the leader.

    A leader's sequence is copied once per SERVED members of its bucket, so a
    leader of a huge group is no one task's work.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    leaders = salted.select("a", "salts", "salt").distinct().join(sequences.select(F.col("v").alias("a"), F.col("seq").alias("seq_a")), "a")
    members = salted.join(sequences.select(F.col("v").alias("b"), F.col("seq").alias("seq_b")), "b")
    both = members.join(leaders, ["a", "salts", "salt"]).select("a", "b", "seq_a", "seq_b")
    return both.mapInArrow(_align, "a long, b long, similarity double")


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A hash that rows share only if they are equal in doc_id and text."""
    return F.xxhash64(F.col(doc_id), F.col(text).cast("string"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_key and row_key of every row of docs(doc_id, text);
    other columns are ignored, doc_id is of any type that has an order.

    class_id is the least doc_id of the documents that are connected by links
    (alignment similarity of at least 0.8) or have equal word sequences.  Null
    text is empty; texts without words are alike if their bytes are.  Rows that
    repeat a doc_id are documents of their own, each with its text's class.  A
    null doc_id takes part; class_id is null only if no document of the class
    has an id, and class_key (a hash) tells all classes apart.  row_key is
    :func:`row_key`.  Word sequences are told apart by 128 bits, the vertices of
    links by 64.
    """
    spark = docs.sparkSession
    begin = mark(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", row_key())
    sketches = materialize(keyed.mapInArrow(_sketch, f"doc_id {id_type}, row_key long, k1 long, k2 long, size int, buckets array<long>"), "sketches")
    vertex = F.xxhash64("k1", "k2")
    contents = sketches.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key"), F.first("size").alias("size"), F.first("buckets").alias("buckets"))
    contents = materialize(contents.withColumn("v", vertex), "contents")
    banded = contents.select("v", "row_key", "size", F.explode("buckets").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = materialize(banded.join(shared, "bucket").select("bucket", "v", "size", "row_key"), "members")
    labels = _resolve(spark, members, keyed)
    linked = contents.select("v", "least").join(labels, "v")
    least = linked.groupBy("label").agg(F.min("least").alias("class_id"))
    named = materialize(labels.join(least, "label").select("v", F.col("label").alias("class_key"), "class_id"), "classes")
    classes = contents.select("k1", "k2", "v", "least").join(named.withColumn("in_class", F.lit(True)), "v", "left")
    classes = classes.select("k1", "k2", F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("class_key", "v").alias("class_key"))
    release(spark, begin, (sketches, contents, named))
    return sketches.select("doc_id", "row_key", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id", "class_key", "row_key")


def _profile(seq: bytes) -> bytes:
    """Counts of the shingles by hash; four bytes a counter where two don't do."""
    x = np.frombuffer(seq, np.uint32).astype(np.uint64)
    counts = np.bincount((x * np.uint64(PROFILE) >> np.uint64(32)).astype(np.int64), minlength=PROFILE)
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _profiles(batches):
    """Shingle profiles: the minima of two bound what the texts share."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([_profile(x) for x in batch.column("seq").to_pylist()], pa.binary())], names=["v", "profile"])


def spanning_forest(a: np.ndarray, b: np.ndarray, strength: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Indexes of edges (a, b) that connect the components as all edges do, the strongest ones.

    a and b index ``component``; each pass takes the best edge of every component.
    """
    _, own = np.unique(component, return_inverse=True)
    order = np.argsort(-strength, kind="stable")
    chosen = [np.zeros(0, np.int64)]
    while True:
        order = order[own[a[order]] != own[b[order]]]
        if not len(order):
            return np.unique(np.concatenate(chosen))
        x, y = own[a[order]], own[b[order]]
        here, at = np.unique(np.stack([x, y], axis=1).ravel(), return_index=True)
        best = at // 2
        chosen.append(order[best])
        parent = np.arange(own.max() + 1)
        parent[here] = x[best] + y[best] - here
        roots = (parent[parent] == np.arange(len(parent))) & (np.arange(len(parent)) < parent)
        parent[roots] = np.flatnonzero(roots)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        own = parent[own]


def _bounded_pairs(table: pa.Table, forest: bool = False) -> pa.Table:
    """Pairs of a group of a bucket's members that aren't connected yet and whose
    sizes and profiles leave room for the similarity.  Members of one home are
    paired only in groups with low = high.

    If a forest is asked for, a spanning forest of these pairs, and one row
    (a, bucket, size) for each member that is in any of them.
    """
    table = table.sort_by("size")
    v, label, size, home = (table.column(c).to_numpy() for c in ("v", "label", "size", "home"))
    raw = [np.frombuffer(x, np.uint16 if len(x) == 2 * PROFILE else np.uint32) for x in table.column("profile").to_pylist()]
    profile = np.stack(raw)
    within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    live, held = np.zeros(len(v), bool), 0
    for at in range(0, len(v), step := max(1, 4096 // max(1, len(v)))):
        rows = np.arange(at, min(at + step, len(v)))
        others = np.arange(at + 1, np.searchsorted(size, (size[rows[-1]] + 1e-6) / SIMILARITY, "right"))
        ok = (size[rows, None] >= SIMILARITY * size[others] - 1e-6) & (label[rows, None] != label[others]) & (rows[:, None] < others)
        if not within:
            ok &= home[rows, None] != home[others]
        i, j = np.nonzero(ok)
        for k in range(0, len(i), 8192):
            x, y = rows[i[k : k + 8192]], others[j[k : k + 8192]]
            shared = np.minimum(profile[x], profile[y]).sum(axis=1, dtype=np.int64)
            union = size[x].astype(np.int64) + size[y] - shared
            ok = shared >= SIMILARITY * union - 1e-6
            out.append((x[ok], y[ok], shared[ok] / np.maximum(union[ok], 1)))
            live[x[ok]] = live[y[ok]] = True
            held += len(out[-1][0])
        if forest and held > HELD_PAIRS:
            out = [_forest(out, label)]
            held = 0
    x, y, _ = _forest(out, label) if forest else (np.concatenate(o) for o in zip(*out))
    a, b = v[x], v[y]
    pairs = {"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "bucket": pa.nulls(len(a), pa.int64()), "size": pa.nulls(len(a), pa.int32())}
    if not forest:
        return pa.table(pairs)
    members = table.filter(pa.array(live)).select(["v", "bucket", "size"])
    left = {"a": members.column("v"), "b": pa.nulls(members.num_rows, pa.int64()), "bucket": members.column("bucket"), "size": members.column("size").cast(pa.int32())}
    return pa.concat_tables([pa.table(pairs), pa.table(left)])


def _forest(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray) -> tuple[np.ndarray, ...]:
    x, y, strength = (np.concatenate(o) for o in zip(*pairs))
    kept = spanning_forest(x, y, strength, label)
    return x[kept], y[kept], strength[kept]


def _all_pairs(table: pa.Table) -> pa.Table:
    return _bounded_pairs(table, False)


def _forest_pairs(table: pa.Table) -> pa.Table:
    return _bounded_pairs(table, True)


def _dealt(met: DataFrame) -> DataFrame:
    """(bucket, low, high, v, label, size, home): the members of met(bucket, v, label, size, n), by the groups in which they are paired.

    A bucket of up to two blocks is one group.  In a larger one any two members
    of different labels meet in exactly one group of a few blocks:

    * if all labels but the most frequent fill no more than a block, that label is
      dealt into blocks, and only the other members are in every group;
    * else members are dealt onto the points of a square of prime side, and the
      groups are its lines: a member is in one more than the side, so rows grow
      with n * sqrt(n / BLOCK) and not with n * n / BLOCK.  Members of one point
      meet on all its lines and are paired on the one with low = high.
    """
    whole = met.where(F.col("n") <= 2 * BLOCK).select("bucket", F.lit(0).alias("low"), F.lit(0).alias("high"), "v", "label", "size", F.lit(0).alias("home"))
    large = met.where(F.col("n") > 2 * BLOCK)
    if large.isEmpty():
        return whole
    labels = large.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    main = labels.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("main"))
    group = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    own, blocks = F.col("label") == F.col("main.label"), F.ceil(F.col("main.c") / BLOCK).cast("int")
    served = F.when(own, F.array(F.pmod(F.xxhash64("v"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
    star = F.transform(served, lambda k: group(k, F.when(k == 0, 0).otherwise(-1)))
    side = F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, SIDES)), lambda p: p * p * F.lit(BLOCK).cast("long") >= F.col("n"))), F.lit(SIDES[-1]))
    rows = large.join(main, "bucket").withColumn("side", side).withColumn("point", F.pmod(F.xxhash64("v"), F.col("side") * F.col("side")).cast("int"))
    x, y = F.floor(F.col("point") / F.col("side")).cast("int"), F.col("point") % F.col("side")
    slopes = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda m: group(m, F.col("side") + F.pmod(y - m * x, F.col("side"))))
    few = F.col("n") - F.col("main.c") <= BLOCK
    groups = F.when(few, star).otherwise(F.concat(F.array(group(x, x)), slopes))
    home = F.when(few, F.when(own, 0).otherwise(1)).otherwise(F.col("point"))
    rows = rows.select("bucket", "v", "label", "size", home.alias("home"), F.explode(groups).alias("g"))
    return whole.unionByName(rows.select("bucket", "g.low", "g.high", "v", "label", "size", "home"))


def _block_pairs(met: DataFrame, profiles: DataFrame, forest: bool) -> DataFrame:
    """(a, b, bucket, size) of :func:`_bounded_pairs`: what an alignment has still to decide of met(bucket, v, label, size, n)."""
    rows = _dealt(met).join(profiles, "v")
    return rows.groupBy("bucket", "low", "high").applyInArrow(_forest_pairs if forest else _all_pairs, "a long, b long, bucket long, size int")


def _label_counts(batches):
    """The labelled shingles of each sequence, one list a row."""
    for batch in batches:
        seqs = [np.frombuffer(x, np.uint32).astype(_U) for x in batch.column("seq").to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64)
        labels = _labelled(np.concatenate([np.zeros(0, _U), *seqs]), cuts)
        yield pa.RecordBatch.from_arrays([list_array(pa.array(labels.view(np.int64)), cuts)], names=["shingles"])


def _prefixes(frequent):
    def run(batches):
        last = frequent.value
        for batch in batches:
            seqs = [np.frombuffer(x, np.uint32).astype(_U) for x in batch.column("seq").to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64)
            keys, counts = prefix_keys(_labelled(np.concatenate([np.zeros(0, _U), *seqs]), cuts), cuts, np.arange(len(seqs)), last)
            lists = list_array(pa.array(keys.view(np.int64)), np.concatenate([[0], np.cumsum(counts)]))
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("label"), batch.column("size"), lists], names=["v", "label", "size", "shingles"])

    return run


def _prefix_groups(large: DataFrame, sequences: DataFrame) -> DataFrame:
    """(bucket, v, label, size, n): members of large buckets dealt anew by a prefix filter.

    Any two of the similarity share a group.  Shingles that many hold come last
    in the filter's order, so what fills the large buckets fills no group here.
    """
    spark = large.sparkSession
    vertices = materialize(large.select("v", "label", "size").distinct(), "large")
    own = materialize(sequences.join(vertices, "v").select("v", "label", "size", "seq"), "large-sequences")
    total = vertices.agg(F.sum("size")).first()[0] or 0
    counted = own.select("seq").mapInArrow(_label_counts, "shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    # no more than FREQUENT shingles can be in more than their share of all
    often = counted.where(F.col("n") > max(2, -(-total // FREQUENT))).select("s").toArrow().column("s").to_numpy()
    last = spark.sparkContext.broadcast(np.sort(often.astype(np.int64).view(_U)))
    keyed = own.mapInArrow(_prefixes(last), "v long, label long, size int, shingles array<long>")
    keyed = materialize(keyed.select("v", "label", "size", F.explode("shingles").alias("bucket")), "prefixes")
    span = keyed.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    return keyed.join(span.select("bucket", "n"), "bucket")


def _remaining_pairs(met: DataFrame, sequences: DataFrame, forest: bool, refined: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, salts), and of a forest the members (bucket, v, size) that may still link in their bucket.

    Large buckets are dealt anew by a prefix filter, unless ``refined`` says that
    they are groups of it already.
    """
    profiles = sequences.select("v", "seq").mapInArrow(_profiles, "v long, profile binary")
    large = met.where(F.col("n") > BLOCK)
    if refined or large.isEmpty():
        found = _block_pairs(met.select("bucket", "v", "label", "size", "n"), profiles, forest)
    else:
        found = _block_pairs(met.where(F.col("n") <= BLOCK).select("bucket", "v", "label", "size", "n").unionByName(_prefix_groups(large, sequences).select("bucket", "v", "label", "size", "n")), profiles, forest)
    left = None
    if forest:
        found = materialize(found, "bounded")
        left = found.where("b IS NULL").select("bucket", F.col("a").alias("v"), "size").distinct()
    return found.where("b IS NOT NULL").select("a", "b").distinct().withColumn("salts", F.lit(16)), left


def _resolve(spark, members: DataFrame, keyed: DataFrame) -> DataFrame:
    """(v, label) of the vertices that some link reached."""
    ids = materialize(members.select("row_key").distinct(), "row-keys")
    small = ids.count() <= BROADCAST_IDS
    needed = keyed.join(F.broadcast(ids) if small else ids, "row_key", "left_semi")
    sequences = needed.select("text").mapInArrow(_sequences, "k1 long, k2 long, seq binary").withColumn("v", F.xxhash64("k1", "k2"))
    sequences = materialize(sequences.select("v", "seq").dropDuplicates(["v"]), "sequences")
    current = members.select("bucket", "v", "size", F.col("v").alias("label"))
    edges = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "v long, label long")
    rounds = (*LEADERS, *[(0, 0, False)] * (FORESTS + 1))
    for n, (first, last, single) in enumerate(rounds):
        rank = [F.xxhash64(F.lit(k), "v") for k in range(first, max(last, first + 1))]
        found = F.array_distinct(F.array(*[F.min_by(F.struct("v", "label", "size"), r) for r in rank]))
        lead = current.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), found.alias("leaders"))
        met = materialize(current.join(lead.where(F.col("low") != F.col("high")).select("bucket", "n", "leaders"), "bucket"), "met")
        left = None
        if last:
            fits = lambda x: F.least(x["size"], F.col("size")) >= SIMILARITY * F.greatest(x["size"], F.col("size")) - 1e-6
            to_try = F.filter("leaders", lambda x: (x["label"] != F.col("label")) & (x["v"] != F.col("v")) & fits(x))
            pairs = met.select("v", "n", F.explode(F.transform(to_try, lambda x: x["v"])).alias("a"))
            if single:  # a member of a large group is in many of its buckets
                least = F.min_by(F.struct("a", "n"), F.struct(F.xxhash64(F.lit(first), "a"), "n"))
                pairs = pairs.groupBy("v").agg(least.alias("x")).select("v", "x.n", "x.a")
            pairs = pairs.groupBy("a", F.col("v").alias("b")).agg(F.ceil(F.max("n") / SERVED).cast("int").alias("salts"))
        else:
            pairs, left = _remaining_pairs(met, sequences, forest=n + 1 < len(rounds), refined=n > len(LEADERS))
        links = materialize(_links(materialize(pairs, "pairs"), sequences), "links")
        if not links.isEmpty():
            edges = edges.unionByName(links.select("a", "b"))
            old, labels = labels, connected_components(edges)
            if old.inputFiles():
                drop_table(old)
        # after a forest only members go on that have a partner left
        current = met.select("bucket", "v", "size") if left is None else left
        current = current.join(labels, "v", "left").select("bucket", "v", "size", F.coalesce("label", "v").alias("label"))
    return labels
