"""Overlapping spans and near-duplicate token sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import drop_table, materialize


def overlapping_pairs(spans: DataFrame, group: str, order: str) -> DataFrame:
    """Pairs of spans(group, order, start, end) of one group that overlap: an
    interval join whose equality on the group keeps it partitioned."""
    a, b = spans.alias("a"), spans.alias("b")
    return a.join(
        b,
        (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.col(f"a.{order}") < F.col(f"b.{order}")),
    )


#: Counters of how many sets hold an item, by its hash; sets of a group that are compared in one task; bits of a set's sketch; ids, and places of sets, that the executors hold at most.
COUNTERS = 1 << 21
GROUP = 512
SKETCH_BITS = 2048
MOST_IDS, MOST_PLACES = 2_000_000, 200_000


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint32) >> np.uint32(11)).astype(np.int64)


def _count(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        counts += np.bincount(_counter(batch.column("hashes").flatten().to_numpy()), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])


def _rarest(shared, threshold: float):
    def run(batches):
        """The items of each set that one of them must be in any similar set, rarest first, with their places; those of one set alone don't count."""
        counts = shared.value
        for batch in batches:
            n = pc.list_value_length(batch.column("hashes")).to_numpy().astype(np.int64)
            hashes = batch.column("hashes").flatten().to_numpy()
            own, often = np.repeat(np.arange(len(n)), n), counts[_counter(hashes)]
            order = np.lexsort((hashes, often, own))
            keep = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            kept = (place < np.repeat(keep, n)) & (often[order] > 1)
            at = order[kept]
            columns = [pa.array(hashes[at]), batch.column("k").take(pa.array(own[at])), pa.array(n[own[at]].astype(np.int32)), pa.array(place[kept].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "k", "n", "p"])

    return run


def _set_key(items):
    """What equal sets share and different ones don't."""
    return F.sha2(F.array_join(F.sort_array(items), "\u0001"), 256)


def _sketched(batches):
    """Sets' numbers of items, and for each of SKETCH_BITS bits whether an odd number of items has it."""
    for batch in batches:
        n = pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
        bit = batch.column("hashes").flatten().to_numpy().view(np.uint32) % SKETCH_BITS
        sketches = []
        for first in range(0, len(n), 1024):
            size = n[first : first + 1024]
            at = np.repeat(np.arange(len(size)), size) * SKETCH_BITS + bit[n[:first].sum() :][: size.sum()]
            odd = np.bincount(at, minlength=len(size) * SKETCH_BITS).reshape(len(size), SKETCH_BITS) & 1
            sketches += [x.tobytes() for x in np.packbits(odd.astype(np.uint8), axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("set_key"), pa.array(n.astype(np.int32)), pa.array(sketches, pa.binary())], names=["id", "set_key", "n", "sketch"])


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _alike(threshold: float):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        """Pairs of a group that may be similar: two sketches differ in no more bits than the sets in items."""
        n = sets.column("n").to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(sets.column("sketch").to_pylist()), np.uint8).reshape(len(n), SKETCH_BITS // 8)
        rows = sets.select(["k"]).to_pandas().reset_index(names="row")
        both = pairs.select(["ka", "kb"]).to_pandas().merge(rows.rename(columns={"k": "ka", "row": "a"}), on="ka").merge(rows.rename(columns={"k": "kb", "row": "b"}), on="kb")
        a, b = both["a"].to_numpy(), both["b"].to_numpy()
        differ = np.concatenate([np.zeros(0, np.int64), *(_ONES[bits[a[x : x + 8192]] ^ bits[b[x : x + 8192]]].sum(axis=1, dtype=np.int64) for x in range(0, len(a), 8192))])
        near = both.loc[differ <= (1 - threshold) / (1 + threshold) * (n[a] + n[b]) + 1e-6, ["ka", "kb"]].drop_duplicates()
        return pa.Table.from_pandas(near, pa.schema([("ka", pa.int64()), ("kb", pa.int64())]), preserve_index=False)

    return run


def _compared(threshold: float):
    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        """Pairs of a group that are similar; the items are compared as strings."""
        rows = sets.select(["k", "id"]).to_pandas()
        rows = rows[~rows.duplicated()].sort_values("k", kind="stable")
        keys, row = rows["k"].to_numpy(), rows.index.to_numpy()
        items = sets.column("items").combine_chunks()
        n = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(n) - n
        codes = items.flatten().dictionary_encode().indices.to_numpy()
        ka, kb = (pairs.column(x).to_numpy() for x in ("ka", "kb"))
        order = np.argsort(ka, kind="stable")
        ka, kb = ka[order], kb[order]
        # sets that are equal in 64 bits only have several rows
        from_b, to_b = np.searchsorted(keys, kb, "left"), np.searchsorted(keys, kb, "right")
        held, found = np.zeros(codes.max(initial=-1) + 1, bool), []
        edges = np.flatnonzero(np.diff(ka)) + 1
        for low, high in zip([0, *edges], [*edges, len(ka)], strict=True):
            if low == high:
                continue
            many = to_b[low:high] - from_b[low:high]
            other = row[np.arange(many.sum()) + np.repeat(from_b[low:high] - np.cumsum(many) + many, many)]
            if not len(other):
                continue
            size = n[other]
            at = np.arange(size.sum()) + np.repeat(start[other] - np.cumsum(size) + size, size)
            for left in row[np.searchsorted(keys, ka[low], "left") : np.searchsorted(keys, ka[low], "right")]:
                own = codes[start[left] : start[left] + n[left]]
                held[own] = True
                both = np.add.reduceat(held[codes[at]], np.cumsum(size) - size, dtype=np.int64)
                held[own] = False
                jaccard = both / (n[left] + size - both)
                near = jaccard >= threshold - 1e-12
                found.append((np.full(near.sum(), left), other[near], jaccard[near]))
        left, right, jaccard = (np.concatenate([np.zeros(0, kind), *(x[i] for x in found)]) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table([sets.column("id").take(pa.array(left)), sets.column("id").take(pa.array(right)), pa.array(jaccard)], names=["ra", "rb", "jaccard"])

    return run


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (ka, kb) with the group g in which they are compared.

    Sets with the same least neighbour of a neighbour get a label, and at most
    about GROUP sets of a label a part, so that a cluster of alike sets meets in
    few groups, however many pairs it has.
    """
    both = pairs.select(F.col("ka").alias("k"), F.col("kb").alias("o")).unionByName(pairs.select(F.col("kb").alias("k"), F.col("ka").alias("o")))
    least = both.groupBy("k").agg(F.min("o").alias("o")).select(F.col("k").alias("o"), F.least("k", "o").alias("label"))
    labels = both.join(least, "o").groupBy("k").agg(F.min("label").alias("label"))
    parts = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    places = materialize(labels.join(parts, "label").select("k", F.xxhash64("label", F.pmod(F.xxhash64("k"), F.col("parts"))).alias("part")), "jaccard-places")
    groups = max(1, places.count() // GROUP)
    a, b = (places.select(F.col("k").alias(f"k{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
    g = F.pmod(F.xxhash64(F.least("pa", "pb"), F.greatest("pa", "pb")), F.lit(groups)).cast("int").alias("g")
    return materialize(pairs.join(a, "ka").join(b, "kb").select("ka", "kb", g), "jaccard-dealt")


def _copies(classes: DataFrame, dealt: DataFrame) -> DataFrame:
    """The classes in dealt pairs, with the groups gs that each is needed in."""
    groups = dealt.select("g", F.explode(F.array("ka", "kb")).alias("k")).groupBy("k").agg(F.collect_set("g").alias("gs"))
    return materialize(classes.select("k", "set_key", "id").join(groups, "k"), "jaccard-copies")


def _of(table: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of a table whose id is a class's."""
    ids = classes.select("id").distinct()
    return table.join(F.broadcast(ids) if classes.count() <= MOST_IDS else ids, "id", "left_semi")


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of sets(id, items: array of distinct strings) with Jaccard >= threshold.

    Exact by prefix filtering: two sets that similar share one of their rarest
    n - ceil(threshold * n) + 1 items, and after the first one they share enough
    must be left in both, so only those are joined, as 32-bit hashes; any common
    order will do, and the one taken counts items by hash.  Items are hashed once
    and written.  Pairs whose sketches differ in more bits than similar sets may
    in items are left out.  For the rest the items themselves are read again, dealt
    out once to each group of alike sets, not to each pair, and compared as strings.  Sets that are equal stand behind their least id; hence
    copies aren't joined.  Sets are told apart by 64 bits until the last.
    """
    spark = sets.sparkSession
    # generated, so that what reads the items doesn't make each its own
    once = sets.select("id", F.explode(F.array("items")).alias("items")).where(F.size("items") > 0)
    columns = [F.xxhash64(F.sort_array("items")).alias("k"), _set_key("items").alias("set_key"), F.transform("items", lambda x: F.hash(x)).alias("hashes")]
    hashed = materialize(once.select("id", *columns), "jaccard-hashes")
    found = hashed.select("hashes").mapInArrow(_count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int32)
    counts[found.column("at").to_numpy()] = np.minimum(found.column("n").to_numpy(), np.iinfo(np.int32).max)
    prefix = hashed.select("k", "hashes").mapInArrow(_rarest(spark.sparkContext.broadcast(counts), threshold), "item int, k long, n int, p int").repartition("item").distinct()
    a, b = prefix.alias("a"), prefix.alias("b")
    left_over = F.least(F.col("a.n") - F.col("a.p"), F.col("b.n") - F.col("b.p")) >= threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-6
    close = (F.col("a.item") == F.col("b.item")) & (F.col("a.k") < F.col("b.k")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-6) & left_over
    pairs = materialize(a.join(b, close).select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).distinct(), "jaccard-pairs")
    dealt = _dealt(pairs)
    # what is equal in 64 bits may still differ
    copies = _copies(hashed.groupBy("k", "set_key").agg(F.min("id").alias("id")), dealt)
    kind = sets.schema["id"].dataType.simpleString()
    sketches = _of(hashed, copies).select("id", "set_key", "hashes").mapInArrow(_sketched, f"id {kind}, set_key string, n int, sketch binary")
    sketches = sketches.join(copies, ["id", "set_key"]).select(F.explode("gs").alias("g"), "k", "n", "sketch")
    alike = materialize(sketches.groupBy("g").cogroup(dealt.groupBy("g")).applyInArrow(_alike(threshold), "ka long, kb long"), "jaccard-alike")
    drop_table(hashed)
    drop_table(pairs)
    drop_table(dealt)
    dealt = _dealt(alike)
    places = _copies(copies, dealt)
    needed = _of(sets, places).select("id", F.explode(F.array("items")).alias("items"))
    held = F.broadcast(places) if places.count() <= MOST_PLACES else places
    full = needed.select("id", "items", _set_key("items").alias("set_key")).join(held, ["id", "set_key"]).select(F.explode("gs").alias("g"), "k", "id", "items")
    near = full.groupBy("g").cogroup(dealt.groupBy("g")).applyInArrow(_compared(threshold), f"ra {kind}, rb {kind}, jaccard double")
    return near.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "jaccard")
