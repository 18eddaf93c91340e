"""Sequence packing by a grouping genetic algorithm on islands.

Documents become token ids (Arrow batches, no shuffle), longer ones are cut, and
full pieces are sequences of their own.  The other pieces are dealt to islands of
a bounded size.  On an island an individual is a packing and its genes are whole
bins: crossover injects well-filled bins of one parent into the other and removes
the bins that then hold a document twice.  Displaced documents first replace
smaller ones wherever that fills a bin better, and what is left is placed
best-fit.  After each epoch full bins settle; the others of each island's best
packing, the emptiest half at most, emigrate whole to a merged island, where the
immigrants' bins found the next population.  That ends when a single island is
left, or when its documents can't be packed into fewer bins.

Only piece lengths travel: token ids stay in the task that made them.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, slices

CAPACITY = 1024
END_ID = 2
ISLAND_PIECES = 8192

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """texts -> list of id lists, as tokenizers gives them without special tokens added.

    A byte-level BPE whose merges are in order of id runs in tiktoken's merge
    loop, which is several times faster and gives the same ids.  Texts that this
    loop refuses (its pattern can't cross very long white space) and any other
    file run in tokenizers itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocabulary = model["vocab"] if isinstance(model.get("vocab"), dict) else {}
    simple = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        and not model.get("dropout") and not model.get("ignore_merges") and all(vocabulary.get(a + b) == 256 + n for n, (a, b) in enumerate(merges))
        and all(t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    )
    if simple:
        import tiktoken

        symbols = _byte_symbols()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if token not in added}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        specials = set(added)

        def ids(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special=specials)
            except ValueError:
                return tokenizer.encode(text, add_special_tokens=False).ids

        return lambda texts: [ids(t) for t in texts]
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenize(path: str, capacity: int):
    def run(batches):
        encode = encoder(path)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                row, piece, start, length, crc = [], [], [], [], []
                for n, ids in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                    raw = np.array([*ids, END_ID], "<u4")
                    for k, (at, size) in enumerate(piece_bounds(len(raw), capacity)):
                        row.append(n)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[at : at + size]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


class Packing:
    """Bins of items with an index by free space."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def copy_without(self, drop: set[int]) -> Packing:
        out = Packing(self.sizes, self.capacity)
        for n, (b, f) in enumerate(zip(self.bins, self.free)):
            if n not in drop:
                out.bins.append(b)
                out.free.append(f)
        return out

    def add(self, items: list[int]) -> None:
        self.bins.append(items)
        self.free.append(self.capacity - sum(self.sizes[i] for i in items))

    def best_fit(self, items: list[int]) -> None:
        """Place items, largest first, where the least space is left over."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for n, f in enumerate(self.free):
            if f:
                by_free[f].append(n)
                mask |= 1 << f
        for i in sorted(items, key=lambda x: (-self.sizes[x], x)):
            size = self.sizes[i]
            fitting = mask >> size
            if fitting:
                f = size + (fitting & -fitting).bit_length() - 1
                n = by_free[f].pop()
                if not by_free[f]:
                    mask &= ~(1 << f)
                self.bins[n] = [*self.bins[n], i]
            else:
                n, f = len(self.bins), self.capacity
                self.bins.append([i])
                self.free.append(f)
            self.free[n] = f = f - size
            if f:
                by_free[f].append(n)
                mask |= 1 << f

    def fitness(self) -> tuple[int, int]:
        """Fewer bins first, then fuller full ones (sum of squares)."""
        return (-len(self.bins), sum((self.capacity - f) ** 2 for f in self.free))


def replace(packing: Packing, bins: int, displaced: list[int]) -> list[int]:
    """Put displaced items in the place of one or two smaller ones of the first ``bins`` bins
    where that fills a bin better; returns what is displaced then."""
    sizes = packing.sizes
    pool = sorted(displaced, key=lambda i: (sizes[i], i))
    keys = [sizes[i] for i in pool]
    for n in range(bins):
        free, items = packing.free[n], packing.bins[n]
        best = (0, (), 0)
        for a in range(len(items) if free else 0):
            for out in ((a,), *((a, b) for b in range(a + 1, len(items)))):
                size = sum(sizes[items[x]] for x in out)
                k = bisect_right(keys, size + free) - 1
                if k >= 0 and keys[k] - size > best[0]:
                    best = (keys[k] - size, out, k)
            if best[0] == free:
                break
        gain, out, k = best
        if gain:
            keys.pop(k)
            packing.bins[n] = [x for y, x in enumerate(items) if y not in out] + [pool.pop(k)]
            packing.free[n] = free - gain
            for x in out:
                at = bisect_right(keys, sizes[items[x]])
                keys.insert(at, sizes[items[x]])
                pool.insert(at, items[x])
    return pool


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """Inject well-filled bins of b into a; displaced documents replace smaller ones or go best-fit."""
    noise = rng.random(len(b.bins))
    order = sorted(range(len(b.bins)), key=lambda n: (b.free[n], noise[n]))
    best = order[: max(1, len(order) // 2)]
    count = max(1, int(len(best) * rng.uniform(0.1, 0.6)))
    chosen = [best[i] for i in rng.choice(len(best), size=min(count, len(best)), replace=False)]
    injected = {i for n in chosen for i in b.bins[n]}
    owner = {i: n for n, items in enumerate(a.bins) for i in items}
    hit = sorted({owner[i] for i in injected})
    child = a.copy_without(set(hit))
    displaced = replace(child, len(child.bins), [i for n in hit for i in a.bins[n] if i not in injected])
    for n in chosen:
        child.add(list(b.bins[n]))
    child.best_fit(displaced)
    return child


def mutate(a: Packing, rng: np.random.Generator) -> Packing:
    """Empty some of the worst-filled bins and a few others, and place their documents anew."""
    order = sorted(range(len(a.bins)), key=lambda n: (-a.free[n], n))
    worst = order[: max(2, len(order) // 10)]
    some = rng.choice(len(a.bins), size=max(1, len(a.bins) // 20), replace=False).tolist()
    drop = sorted({*worst, *some})
    child = a.copy_without(set(drop))
    child.best_fit(replace(child, len(child.bins), [i for n in drop for i in a.bins[n]]))
    return child


def evolve(sizes: list[int], founders: list[list[int]], capacity: int, seed: int, population: int = 6, generations: int = 12) -> Packing:
    """The best packing of one island; founders are bins that immigrants brought along."""
    rng = np.random.default_rng(seed)
    decreasing = Packing(sizes, capacity)
    decreasing.best_fit(list(range(len(sizes))))
    pool = [decreasing]
    if founders:
        elite = Packing(sizes, capacity)
        for b in founders:
            elite.add(b)
        pool.append(elite)
    while len(pool) < population:
        pool.append(mutate(pool[int(rng.integers(0, min(2, len(pool))))], rng))
    least = -(-sum(sizes) // capacity)
    for _ in range(generations):
        pool.sort(key=Packing.fitness, reverse=True)
        # with one bin to spare, all others are full: nothing is left to gain
        if len(pool[0].bins) == least and sum(map(bool, pool[0].free)) <= 1:
            break
        children = []
        for _ in range(population):
            i, j = sorted(rng.choice(len(pool), 2, replace=False).tolist())
            child = crossover(pool[i], pool[j], rng)
            children.append(mutate(child, rng) if rng.random() < 0.5 else child)
        pool = sorted([*pool, *children], key=Packing.fitness, reverse=True)[:population]
    return max(pool, key=Packing.fitness)


def emigrants(best: Packing) -> set[int]:
    """Bins that aren't full, of which the emptiest half of all bins at most."""
    order = sorted((n for n, f in enumerate(best.free) if f), key=lambda n: (-best.free[n], n))
    return set(order[: max(1, len(best.bins) // 2)])


def _island(epoch: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sizes = table.column("length").to_pylist()
        island = table.column("island")[0].as_py()
        founders: dict[int, list[int]] = {}
        for n, b in enumerate(table.column("bin").to_pylist()):
            if b is not None:
                founders.setdefault(b, []).append(n)
        best = evolve(sizes, list(founders.values()), capacity, seed=island * 31 + epoch)
        bin_of, offset, moves = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes)
        leaving = emigrants(best)
        for n, items in enumerate(best.bins):
            at = 0
            for i in items:
                bin_of[i] = (((epoch << 32) + island) << 24) + n
                offset[i], moves[i] = at, n in leaving
                at += sizes[i]
        kept = table.drop_columns(["bin", "offset", "moves"])
        return kept.append_column("bin", pa.array(bin_of, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("moves", pa.array(moves, pa.bool_()))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, island_pieces: int = ISLAND_PIECES) -> DataFrame:
    """Pack all rows of docs(doc_id, text) into sequences of at most ``capacity`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.  A null or empty text is the end id alone.  Repeated
    rows are separate documents; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fields = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(texts.mapInArrow(_tokenize(tokenizer_path, capacity), fields).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done = [pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("uid")).alias("bin"), F.lit(0).cast("long").alias("offset"))]
    none = F.lit(None).cast("long")
    left = pieces.where(F.col("length") < capacity).select("*", none.alias("bin"), none.alias("offset"), F.lit(None).cast("boolean").alias("moves"), F.xxhash64("uid").alias("place"))
    schema = fields + ", uid long, place long, island long, bin long, offset long, moves boolean"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "uid", "bin", "offset"]
    epoch = 0
    while True:
        islands = max(1, -(-left.count() // island_pieces))
        placed = left.withColumn("island", F.pmod(F.col("place"), F.lit(islands)))
        out = materialize(placed.groupBy("island").applyInArrow(_island(epoch, capacity), schema), f"epoch{epoch}")
        # an island's emigrating bins go together
        left = out.where("moves").select(*(c for c in out.columns if c not in ("island", "place")), F.xxhash64("island").alias("place"))
        bins, size = left.agg(F.count_distinct("bin"), F.sum("length")).first()
        if islands == 1 or bins <= -(-(size or 0) // capacity):
            done.append(out.select(columns))
            break
        done.append(out.where("not moves").select(columns))
        epoch += 1
    packed = done[0]
    for part in done[1:]:
        packed = packed.unionByName(part)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
