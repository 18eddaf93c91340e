"""Benchmark decontamination with an FM-index per shard of training text.

Each slice of an Arrow batch (about 4 MB of text, whole rows) is one shard.  Its
words become symbols of the benchmark's vocabulary; words that no benchmark item
contains can't be part of an occurrence, so runs shorter than the shortest
window between two such words are left out of the index (this loses nothing).
Over the rest the kernel builds a suffix array, the Burrows-Wheeler transform
and a wavelet matrix, runs the backward search of all test windows at once
through its ranks, locates the occurrences from sampled suffix positions, and
merges them to removal spans.  There is no shuffle: a document's result depends
on that document and the benchmark alone.

The benchmark is the only thing broadcast.  Its size is checked first: beyond
``block_bytes`` of text it is dealt into blocks below that size, and one block
after the other is searched against all rows.

Words are looked up by 64-bit hashes; the words of every occurrence are then
compared letter by letter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import materialize, slices, text_bytes

RUN = "array<struct<start:int,end:int>>"


@dataclass
class TestWindows:
    """Windows of the benchmark items over a vocabulary of word hashes."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = 2 + index
    groups: list  # of (window length, symbols [windows x length], first window id)
    item_offsets: np.ndarray  # of the items of each window
    item_index: np.ndarray
    item_ids: list  # as strings
    letters: np.ndarray  # the vocabulary's words one after the other, lower-cased
    letter_offsets: np.ndarray

    @property
    def shortest(self) -> int:
        return min((length for length, _, _ in self.groups), default=0)


def test_windows(items: list[tuple], window: int) -> TestWindows:
    """items: (item_id, text); a null id is skipped, a null text has no words."""
    items = [(str(i), t or "") for i, t in items if i is not None]
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    words = K.find_words(data, offsets, K.ALNUM)
    vocabulary, first_at = np.unique(words.hashes, return_index=True)
    letters, letter_offsets = _letters(words, data, first_at)
    symbols = np.searchsorted(vocabulary, words.hashes).astype(np.int64) + 2
    ids = sorted({i for i, _ in items})
    place = {i: n for n, i in enumerate(ids)}
    found: dict[bytes, set[int]] = {}
    for n, (item, _) in enumerate(items):
        own = symbols[words.offsets[n] : words.offsets[n + 1]]
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            found.setdefault(own[at : at + size].tobytes(), set()).add(place[item])
    by_length: dict[int, list[bytes]] = {}
    for key in found:
        by_length.setdefault(len(key) // 8, []).append(key)
    groups, lists, first = [], [], 0
    for length, keys in sorted(by_length.items()):
        groups.append((length, np.frombuffer(b"".join(keys), np.int64).reshape(-1, length), first))
        lists += [sorted(found[k]) for k in keys]
        first += len(keys)
    sizes = [len(x) for x in lists]
    return TestWindows(vocabulary, groups, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array([i for x in lists for i in x], np.int64), ids, letters, letter_offsets)


def _letters(words: K.Words, data: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of some words, and where each begins."""
    size = words.ends[which] - words.starts[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(words.starts[which] - offsets[:-1], size)
    return K.ALNUM[data[at]], offsets


def equal_words(words: K.Words, data: np.ndarray, tests: TestWindows, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words of each occurrence are the vocabulary's, letter by letter."""
    inside = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    which = np.flatnonzero(np.cumsum(inside)[:-1])
    own, own_offsets = _letters(words, data, which)
    symbol = np.searchsorted(tests.vocabulary, words.hashes[which])
    size = np.diff(own_offsets)
    same = size == np.diff(tests.letter_offsets)[symbol]
    at = np.arange(len(own)) - np.repeat(own_offsets[:-1] - tests.letter_offsets[symbol], size)
    wrong = np.repeat(~same, size)
    wrong[~wrong] = own[~wrong] != tests.letters[at[~wrong]]
    differs = np.concatenate([[0], np.cumsum(wrong)])
    bad = np.zeros(len(words.hashes) + 1, np.int64)
    bad[which + 1] = differs[own_offsets[1:]] > differs[own_offsets[:-1]]
    bad = np.cumsum(bad)
    return bad[start + length] == bad[start]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the unique smallest."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        np.cumsum(fresh, out=fresh)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletMatrix:
    """rank(symbol, position) over a sequence of small integers, for arrays of both."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = []
        current = symbols
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (current >> bit) & 1
            zeros_before = np.zeros(len(current) + 1, np.int64)
            np.cumsum(1 - ones, out=zeros_before[1:])
            self.levels.append((bit, zeros_before))
            current = np.concatenate([current[ones == 0], current[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        start = np.zeros_like(position)
        for bit, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            position = np.where(one, zeros[-1] + position - zeros[position], zeros[position])
            start = np.where(one, zeros[-1] + start - zeros[start], zeros[start])
        return position - start


class FMIndex:
    """Backward search and sampled locate over a symbol sequence (symbols >= 1)."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 8) -> None:
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        self.n = len(text)
        suffixes = suffix_array(text)
        self.bwt = text[suffixes - 1]
        self.matrix = WaveletMatrix(self.bwt, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = suffixes % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each pattern."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, column]
            low[alive] = self.before[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        out, steps, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.slot[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            if len(left):
                symbol = self.bwt[rows]
                rows = self.before[symbol] + self.matrix.rank(symbol, rows)
            steps += 1
        return out


def _reduced(words: K.Words, tests: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """Symbols to index, with separator 1 after each run, and each one's word index."""
    v = tests.vocabulary
    if not len(v) or not len(words.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(v, words.hashes)
    at[at == len(v)] = 0
    known = v[at] == words.hashes
    border = np.zeros(len(known) + 1, bool)
    border[words.offsets] = True
    border[0] = border[-1] = True
    border[1:-1] |= known[1:] != known[:-1]
    edges = np.flatnonzero(border)
    size = np.diff(edges)
    keep = known[edges[:-1]] & (size >= tests.shortest)
    starts, size = edges[:-1][keep], size[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    where = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size + 1)
    symbols = np.ones(offsets[-1], np.int64)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[1:] - 1] = False
    symbols[inner] = at[where[inner]] + 2
    return symbols, where


def search_slice(words: K.Words, tests: TestWindows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences: first word, number of words, window id."""
    symbols, where = _reduced(words, tests)
    found = [(np.zeros(0, np.int64),) * 3]
    if len(symbols):
        index = FMIndex(symbols, len(tests.vocabulary) + 2)
        for length, patterns, first in tests.groups:
            low, high = index.search(patterns)
            hits = high - low
            which = np.repeat(np.arange(len(patterns)), hits)
            rows = np.arange(len(which)) + np.repeat(low - (np.cumsum(hits) - hits), hits)
            found.append((where[index.locate(rows)], np.full(len(rows), length), which + first))
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _kernel(tests_var, last: bool, keep: list):
    def run(batches):
        tests = tests_var.value
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = text_bytes(batch.column("text"))
                words = K.find_words(data, offsets, K.ALNUM)
                runs, items = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
                start, length, window = search_slice(words, tests)
                if len(start):
                    same = equal_words(words, data, tests, start, length)
                    start, length, window = start[same], length[same], window[same]
                document = np.searchsorted(words.offsets, start, "right") - 1
                order = np.argsort(document, kind="stable")
                cuts = np.searchsorted(document[order], np.arange(batch.num_rows + 1))
                for d in np.unique(document):
                    own = order[cuts[d] : cuts[d + 1]]
                    base = int(words.offsets[d])
                    at = start[own] - base
                    runs[d] = _merged([(r["start"], r["end"]) for r in runs[d]] + list(zip(at.tolist(), (at + length[own]).tolist())))
                    runs[d] = [{"start": a, "end": b} for a, b in runs[d]]
                    seen = np.unique(np.concatenate([tests.item_index[tests.item_offsets[w] : tests.item_offsets[w + 1]] for w in np.unique(window[own])]))
                    items[d] = sorted({*items[d], *(tests.item_ids[i] for i in seen)})
                run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                columns = {c: batch.column(c) for c in keep}
                if last:
                    spans = [[] for _ in runs]
                    for d, own in enumerate(runs):
                        if own:
                            base, first = int(words.offsets[d]), int(offsets[d])
                            points = np.concatenate([[0], np.cumsum((data[first : offsets[d + 1]] & 0xC0) != 0x80)])
                            spans[d] = [{"start": int(points[words.starts[base + r["start"]] - first]), "end": int(points[words.ends[base + r["end"] - 1] - first])} for r in own]
                    columns |= {"n_words": pa.array(words.counts, pa.int64()), "n_hit": pa.array([sum(r["end"] - r["start"] for r in own) for own in runs], pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, run_type)}
                else:
                    columns |= {"text": batch.column("text")} | {"runs": pa.array(runs, run_type), "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20, keep: tuple = ("doc_id",)) -> DataFrame:
    """Occurrences of the benchmark's word windows in each document.

    docs needs doc_id and text, benchmark item_id and text; other columns, also
    ones with this result's names, are ignored.  Returns a row per row of docs:
    the columns in keep, n_words, n_hit (words inside an occurrence), items (ids, sorted as
    strings, with an occurring window), spans (merged removal spans in code
    points, end exclusive).  Null or empty text: no words, no hits.  Repeated
    rows are independent.  A benchmark without words: no hits.  Benchmark rows
    with a null item_id are skipped.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = list(keep)
    out = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"), F.expr(f"cast(array() as {RUN})").alias("runs"), F.expr("cast(array() as array<string>)").alias("items"))
    fields = "".join(f"`{c}` {out.schema[c].dataType.simpleString()}, " for c in keep)
    with_text = fields if "text" in keep else fields + "text string, "
    for n in range(blocks):
        block = benchmark.select("item_id", "text")
        if blocks > 1:
            block = block.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        tests = spark.sparkContext.broadcast(test_windows([tuple(r) for r in block.collect()], window))
        last = n == blocks - 1
        schema = f"{fields}n_words long, n_hit long, items array<string>, spans {RUN}" if last else f"{with_text}runs {RUN}, items array<string>"
        out = out.mapInArrow(_kernel(tests, last, keep), schema)
        if not last:  # no task holds two blocks
            out = materialize(out, "benchmark-block")
            tests.unpersist()
    return out


def remove_spans(text, spans):
    """Native: the text without its removal spans (code points, merged, sorted)."""
    n = F.size(spans)
    piece = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]) + 1,
            F.when(i == n, F.length(text)).otherwise(F.get(spans, i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]),
        ),
    )
    return F.array_join(piece, "")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of :func:`find_contamination`."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
tests AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM tests),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, t.item_id FROM places p JOIN tests t ON p.n = t.n AND p.win = t.win),
hit_words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""
