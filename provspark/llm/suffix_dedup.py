"""Passages that repeat across documents, by 50-word windows at their minimisers.

A passage repeats if one of its 50-word windows stands in another document too.
Words are ``[0-9a-z]`` and all beyond ASCII, A-Z lower-cased.  The key of a
window is the least hash of its ten-word sequences, so equal windows have equal
keys, and neighbouring windows mostly share one: a text is cut into runs of
windows of one key.  Runs whose key occurs in one document alone are dropped by
a pre-aggregated count.  The rest carry the 64-bit hashes of their windows to
their key's task, where every window is compared with all others.

Keys of more than ``LARGE`` windows (a phrase that many documents hold) don't
meet in one task.  Their windows are compared in each slice of texts first: a
window of two documents is settled there and two of them stand for all in the
second round, in which windows are dealt by their own hash.  No window is left
out in either way.  Longer passages are the union of their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import list_array, materialize, slices, text_bytes

MIN_WORDS = 50
KEY_WORDS = 10
#: Windows of a key up to which all of them meet in one task.
LARGE = 1 << 17
#: Windows of a run; a longer one is cut.
RUN = 64
#: Parts that the windows of larger keys are dealt to, by their hashes.
PARTS = 512
_U = np.uint64


def window_runs(words: K.Words, key_words: int = KEY_WORDS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one key: first word's index, number of windows, key."""
    n = len(words.hashes)
    span = min_words - key_words + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    least, width = K.rolling(words.hashes, key_words), 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - min_words + 1], least[span - width : span - width + n - min_words + 1])
    # windows that cross a text's end are none
    at = np.flatnonzero(np.repeat(words.offsets[1:], words.counts)[: len(least)] - np.arange(len(least)) >= min_words)
    key = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
    index = np.arange(len(at))
    fresh |= (index - np.maximum.accumulate(np.where(fresh, index, 0))) % RUN == 0
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at))), key[first]


def shared_windows(hashes: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Whether another document has the window too."""
    out = np.zeros(len(hashes), bool)
    if not len(hashes):
        return out
    order = np.argsort(hashes)
    ordered, owner = hashes[order], rid[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    other = np.zeros(len(order), bool)
    other[1:] = ~fresh[1:] & (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    out[order] = np.repeat(np.logical_or.reduceat(other, first), np.diff(np.append(first, len(order))))
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _runs(min_words: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                words = K.find_words(*text_bytes(batch.column("text")), K.ALNUM)
                at, size, key = window_runs(words, min_words=min_words)
                row = np.searchsorted(words.offsets, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), batch.column("rid").take(pa.array(row)), pa.array((at - words.offsets[row]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["key", "rid", "start", "size"],
                )

    return run


def _found(batch: pa.RecordBatch, min_words: int):
    """Runs in the column found: row, start, size, key; and the hashes of their windows."""
    words = K.find_words(*text_bytes(batch.column("text")), K.ALNUM)
    found = batch.column("found")
    flat = found.flatten()
    start, size, key = (flat.field(c).to_numpy().astype(np.int64) for c in ("start", "size", "key"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
    return row, start, size, key, K.rolling(words.hashes, min_words)[_ranges(words.offsets[row] + start, size)]


def _records(min_words: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                row, start, size, key, hashes = _found(batch, min_words)
                offsets = (np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(hashes.tobytes())])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch.column("rid").take(take), batch.column("doc_id").take(take), pa.array(start.astype(np.int32)), packed], names=["key", "rid", "doc_id", "start", "windows"]
                )

    return run


def _spans(rid: pa.Array, doc_id: pa.Array, record: np.ndarray, start: np.ndarray, min_words: int) -> pa.RecordBatch:
    """Spans of windows by their records and starts; windows that follow each other are one span."""
    fresh = np.ones(len(start), bool)
    fresh[1:] = (record[1:] != record[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first, len(start))[1:] - 1
    take = pa.array(record[first])
    return pa.RecordBatch.from_arrays([rid.take(take), doc_id.take(take), pa.array(start[first].astype(np.int32)), pa.array((start[last] + min_words).astype(np.int32))], names=["rid", "doc_id", "start", "end"])


def _groups(batches, column: str):
    """Tables of rows sorted by a column, none of whose values is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column)
        held.append(batch)
        if held[0].column(column)[0] == key[-1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(table.column(column).to_numpy(), key[-1].as_py()))
        yield table.slice(0, cut).combine_chunks().to_batches()[0]
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _compare(min_words: int):
    def run(batches):
        for batch in _groups(batches, "key"):
            packed = batch.column("windows")
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
            hashes = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(_U)
            size = np.diff(offsets) // 8
            record = np.repeat(np.arange(len(size)), size)
            start = _ranges(batch.column("start").to_numpy().astype(np.int64), size)
            hit = np.flatnonzero(shared_windows(hashes, batch.column("rid").to_numpy()[record]))
            yield _spans(batch.column("rid"), batch.column("doc_id"), record[hit], start[hit], min_words)

    return run


def _first_round(min_words: int, parts: int):
    def run(batches):
        """Spans of windows of two documents in a slice (part is null), and by part the windows to compare further."""
        for whole in batches:
            for batch in slices(whole, "text"):
                row, start, size, _, hashes = _found(batch, min_words)
                row, start = np.repeat(row, size), _ranges(start, size)
                # in order of the text: runs of different keys follow each other
                order = np.lexsort((start, row))
                row, start, hashes = row[order], start[order], hashes[order]
                rid = batch.column("rid").to_numpy()[row]
                settled = shared_windows(hashes, rid)
                hit = np.flatnonzero(settled)
                spans = _spans(batch.column("rid"), batch.column("doc_id"), row[hit], start[hit], min_words)
                # of a settled window, those of the least and the greatest document stand for all
                order = hit[np.lexsort((rid[hit], hashes[hit]))]
                fresh = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(order)]
                stand = np.unique(np.concatenate([np.flatnonzero(fresh), np.append(np.flatnonzero(fresh), len(order))[1:] - 1])) if len(order) else np.zeros(0, np.int64)
                send = np.concatenate([np.flatnonzero(~settled), order[stand]])
                part = (hashes[send] % _U(parts)).astype(np.int64)
                send, part = send[(by := np.argsort(part, kind="stable"))], part[by]
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                take = pa.array(row[send])
                entries = pa.StructArray.from_arrays(
                    [pa.array(hashes[send].view(np.int64)), batch.column("rid").take(take), batch.column("doc_id").take(take), pa.array(start[send].astype(np.int32)), pa.array(settled[send])],
                    names=["hash", "rid", "doc_id", "start", "settled"],
                )
                lists = list_array(entries, np.append(first, len(send)))
                n, m = spans.num_rows, len(first)
                columns = [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in spans.columns]
                columns += [pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(part[first].astype(np.int32))]), pa.concat_arrays([pa.nulls(n, lists.type), lists])]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "start", "end", "part", "entries"])

    return run


def _second_round(min_words: int):
    def run(batches):
        for batch in _groups(batches, "part"):
            flat = batch.column("entries").flatten()
            rid, start = flat.field("rid"), flat.field("start").to_numpy().astype(np.int64)
            hit = shared_windows(flat.field("hash").to_numpy().view(_U), rid.to_numpy())
            hit = np.flatnonzero(hit & ~flat.field("settled").to_numpy(zero_copy_only=False))
            yield _spans(rid, flat.field("doc_id"), hit, start[hit], min_words)

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) of the passages of docs(doc_id, text)
    that another document has too, at least ``min_words`` long, merged where they
    overlap or touch.

    A document without such a passage has no row.  Null, empty and short texts
    have none.  Documents are told apart by doc_id and text: rows equal in both
    are one document.  Other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    runs = materialize(rows.select("rid", "text").mapInArrow(_runs(min_words), "key long, rid long, start int, size int"), "runs")
    keys = runs.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.sum("size").alias("n")).where("low != high")

    def inputs(where: str) -> DataFrame:
        kept = runs.join(keys.where(where).select("key"), "key").groupBy("rid").agg(F.collect_set(F.struct("start", "size", "key")).alias("found"))
        return rows.join(kept, "rid").select("rid", "doc_id", "text", "found")

    schema = f"rid long, doc_id {id_type}, start int, end int"
    records = inputs(f"n <= {LARGE}").mapInArrow(_records(min_words), f"key long, rid long, doc_id {id_type}, start int, windows binary")
    small = records.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(min_words), schema)
    entries = f"array<struct<hash: long, rid: long, doc_id: {id_type}, start: int, settled: boolean>>"
    first = materialize(inputs(f"n > {LARGE}").mapInArrow(_first_round(min_words, PARTS), f"{schema}, part int, entries {entries}"), "windows")
    second = first.where("part is not null").select("part", "entries").repartition("part").sortWithinPartitions("part").mapInArrow(_second_round(min_words), schema)
    spans = small.unionByName(first.where("part is null").select("rid", "doc_id", "start", "end")).unionByName(second)
    order = Window.partitionBy("rid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("rid", "doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word")
