"""Language-model scores of documents: add-one unigrams, and a log-bilinear model.

Blocks.  Each task turns about 8 MB of text into one row: the block's distinct
words as sorted 64-bit hashes with their training counts, and the documents'
tokens as indexes among them.  Blocks are written once.

Counts.  Every block sends its words to shards by hash range; a shard adds the
blocks' counts up and answers each block in the block's own order.  A word is one
entry per block however often it occurs, so frequent words are not skewed, and a
shard holds a bounded number of entries.

Model.  A log-bilinear neural model.  Its vocabulary is every word of at least
``LEAST_COUNT`` training occurrences, up to ``VOCABULARY`` words, the most
frequent.  Linear maps of the vectors of the four words before predict a vector;
its products with the words' output vectors give the next word.  For exact
normalisation at a bounded cost, words are grouped into classes of neighbouring
frequency ranks: the probability is that of the class times that of the word in
its class, both from the predicted vector.  All other words, unseen ones too,
fall into classes by their last two bytes with add-one unigrams inside.

Training.  All training tokens train it once, by noise-contrastive estimation in
numpy of both factors.  Documents are dealt by a hash to ``ROUNDS`` rounds and, in a
round, to workers of about ``WORKER_TOKENS`` tokens; the workers of a round start
from the same weights and their results are averaged.  So weights depend on the
corpus only, not on its partitioning.  Scores are normalised log-probabilities
from batched matrix products.

Memory.  A task holds one block at a time, and of its tokens' contexts and scores
one slice, so what it needs doesn't grow with the corpus or with its partitions.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import drop_table, mark, materialize, one_blas_thread, release, slices, text_bytes

BLOCK_BYTES = 8 << 20
SHARD_ENTRIES = 200_000
#: Most words of the model, and the occurrences that a word needs.  They bound the weights: 4.7 MB, broadcast.
VOCABULARY = 1 << 15
LEAST_COUNT = 8
#: Words of a class; classes of words that aren't in the vocabulary.
MEMBERS = 128
TAIL_CLASSES = 64
CONTEXT = 4
DIMENSIONS = 16
CLASS_NOISE, WORD_NOISE = 32, 8
BATCH = 4096
RATE, FIRST_SQUARE = 0.1, 1e-6
ROUNDS = 4
WORKER_TOKENS = 2_000_000
#: Workers whose weights one task averages.
AVERAGED = 8
#: Tokens of a text that are scored at once.
SCORED = 1 << 16
#: Blocks are written in row groups of about this many bytes, so neither their writer nor a reader holds many.
ROW_GROUP = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_U = np.uint64
#: The token that ends a text.
END = _U(0xE4D0_F7E1_7000_0001)


@dataclass
class Counts:
    """What all training tokens add up to, and the vocabulary, most frequent words first."""

    tokens: int  # N
    words: int  # V
    top: np.ndarray  # hashes by rank
    top_counts: np.ndarray
    tail_tokens: np.ndarray  # by tail class, without the vocabulary
    tail_words: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.top)
        self.sorted = self.top[self.order]

    @property
    def size(self) -> int:
        """Words of the vocabulary; the symbols after them are the tail classes, then "before the text"."""
        return len(self.top)

    @property
    def symbols(self) -> int:
        return self.size + TAIL_CLASSES

    @property
    def word_classes(self) -> int:
        return -(-self.size // MEMBERS)

    def classes_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.size, symbols // MEMBERS, symbols - self.size + self.word_classes)


@dataclass
class Weights:
    """inputs [symbols + 1, d], maps [context, d, d], classes and words [.., d + 1] with
    the bias last, and of each row the squares of its gradients so far."""

    inputs: np.ndarray
    maps: np.ndarray
    classes: np.ndarray
    words: np.ndarray
    squares: list

    @property
    def parts(self) -> list:
        return [self.inputs, self.maps, self.classes, self.words]

    def copy(self) -> Weights:
        return Weights(*(x.copy() for x in self.parts), [x.copy() for x in self.squares])

    def to_bytes(self) -> bytes:
        return np.concatenate([x.ravel() for x in (*self.parts, *self.squares)]).astype(np.float32).tobytes()

    def like(self, flat: np.ndarray) -> Weights:
        own = [*self.parts, *self.squares]
        cuts = np.cumsum([x.size for x in own])
        new = [x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, cuts[:-1]), own)]
        return Weights(*new[:4], new[4:])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(7)) == 2, F.lit(False))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique with return_index and return_inverse, but the index is that of any occurrence: no stable sort."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _block(batch: pa.RecordBatch):
    """(distinct hashes, their tail classes, training counts, tokens, offsets) of a batch."""
    hashes, classes, sizes = [], [], []
    for part in slices(batch, "text", 2 << 20):
        data, offsets = text_bytes(part.column("text"))
        words = K.find_words(data, offsets, K.SPACED)
        code = K.SPACED[data].astype(np.int64)
        last = code[words.ends - 1]
        before = np.where(words.ends - words.starts > 1, code[np.maximum(words.ends - 2, 0)], 0)
        tail = ((before * 257 + last) * 40503 >> 3) % TAIL_CLASSES
        n = words.counts + 1
        ends = np.cumsum(n) - 1
        inner = np.ones(int(n.sum()), bool)
        inner[ends] = False
        h = np.full(len(inner), END, _U)
        h[inner] = words.hashes
        t = np.zeros(len(inner), np.uint8)
        t[inner] = tail
        hashes.append(h)
        classes.append(t)
        sizes.append(n)
    hashes, classes, sizes = (np.concatenate(x) for x in (hashes, classes, sizes))
    distinct, first, tokens = _distinct(hashes)
    training = np.repeat(~np.array(batch.column("held_out").to_pylist(), bool), sizes)
    counts = np.bincount(tokens[training], minlength=len(distinct))
    return distinct, classes[first], counts.astype(np.uint32), tokens.astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _blocks(batches):
    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            distinct, tail, counts, tokens, offsets = _block(batch)
            n = pa.array([0, batch.num_rows], pa.int32())
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (distinct, tail, counts, tokens, offsets)]
            lists = [pa.ListArray.from_arrays(n, batch.column(c)) for c in ("doc_id", "held_out", "row_key")]
            yield pa.RecordBatch.from_arrays([pa.array([random.SystemRandom().getrandbits(62)]), pa.array([len(distinct)]), *lists, *raw], names=["block", "n_words", "doc_ids", "held", "row_keys", "words", "tail", "counts", "tokens", "offsets"])


def _deal(shards: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.column("block")[row].as_py()
                words, tail, counts = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("words", _U), ("tail", np.uint8), ("counts", np.uint32)))
                bounds = [(i << 64) // shards for i in range(1, shards)]
                cuts = [0, *np.searchsorted(words, np.array(bounds, _U)).tolist(), len(words)]
                used = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
                raw = [pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()) for x in (words, tail, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), *raw], names=["shard", "block", "words", "tail", "counts"])

    return run


def count_bucket(counts: np.ndarray) -> np.ndarray:
    """Sixteen buckets for each power of two."""
    return np.floor(16 * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _add_up(table: pa.Table) -> pa.Table:
    """Counts of a shard's words in each block's order; one row without a block sums up the shard."""
    shard = table.column("shard")[0].as_py()
    parts = [np.frombuffer(b, _U) for b in table.column("words").to_pylist()]
    words = np.concatenate(parts)
    distinct, first, where = _distinct(words)
    own = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()])
    tail = np.concatenate([np.frombuffer(b, np.uint8) for b in table.column("tail").to_pylist()])[first]
    total = np.bincount(where, weights=own, minlength=len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    answers = [a.tobytes() for a in np.split(total[where], cuts)]
    best = np.lexsort((distinct, -total))[:VOCABULARY]
    best = best[total[best] >= LEAST_COUNT]
    known = total > 0
    sums = {"tokens": np.bincount(tail, weights=total, minlength=TAIL_CLASSES), "words": np.bincount(tail[known], minlength=TAIL_CLASSES), "bucket": np.bincount(count_bucket(total[known]))}
    listed = [{"kind": k, "at": int(i), "n": int(x[i])} for k, x in sums.items() for i in np.flatnonzero(x)]
    n = len(answers)
    return pa.table(
        {
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
            "counts": pa.array([*answers, None], pa.binary()),
            "top": pa.array([None] * n + [distinct[best].tobytes() + total[best].tobytes() + tail[best].tobytes()], pa.binary()),
            "sums": pa.array([None] * n + [listed], pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("n", pa.int64())]))),
        }
    )


def least_bucket(words_by_bucket: dict[int, int]) -> int:
    """The least bucket of counts such that no more than VOCABULARY words are in it or above."""
    least, total = 1 << 20, 0
    for bucket in sorted(words_by_bucket, reverse=True):
        total += words_by_bucket[bucket]
        if total > VOCABULARY:
            break
        least = bucket
    return max(least, int(count_bucket(np.array([LEAST_COUNT]))[0]))


def _vocabulary(least: int):
    def run(batches):
        for batch in batches:
            for raw in batch.column("top").to_pylist():
                n = len(raw) // 17
                words, counts, tail = np.frombuffer(raw[: 8 * n], np.int64), np.frombuffer(raw[8 * n : 16 * n], np.int64), np.frombuffer(raw[16 * n :], np.uint8)
                keep = (counts >= LEAST_COUNT) & (count_bucket(counts) >= least)
                yield pa.RecordBatch.from_arrays([pa.array(words[keep]), pa.array(counts[keep]), pa.array(tail[keep].astype(np.int32))], names=["word", "n", "tail"])

    return run


def gather_counts(added: DataFrame) -> Counts:
    """Sums of all shards, and the vocabulary: about a thousand rows and at most VOCABULARY rows reach the driver."""
    shards = added.where("block is null")
    sums: dict[str, dict[int, int]] = {"tokens": {}, "words": {}, "bucket": {}}
    for r in shards.select(F.explode("sums").alias("s")).groupBy("s.kind", "s.at").agg(F.sum("s.n").alias("n")).collect():
        sums[r["kind"]][r["at"]] = r["n"]
    found = shards.select("top").mapInArrow(_vocabulary(least_bucket(sums["bucket"])), "word long, n long, tail int").toArrow()
    words, counts, tails = (found.column(c).to_numpy() for c in ("word", "n", "tail"))
    words = words.astype(np.int64).view(_U)
    tokens, distinct = (np.array([sums[k].get(i, 0) for i in range(TAIL_CLASSES)], np.int64) for k in ("tokens", "words"))
    n, v = int(tokens.sum()), int(distinct.sum())
    tail_tokens = tokens - np.bincount(tails, weights=counts, minlength=TAIL_CLASSES).astype(np.int64)
    order = np.lexsort((words, -counts))
    return Counts(n, v, words[order], counts[order], tail_tokens, distinct - np.bincount(tails, minlength=TAIL_CLASSES))


def symbols_of(words: np.ndarray, tail: np.ndarray, counts: Counts) -> np.ndarray:
    if not counts.size:
        return tail.astype(np.int64)
    at = np.minimum(np.searchsorted(counts.sorted, words), counts.size - 1)
    return np.where(counts.sorted[at] == words, counts.order[at], counts.size + tail.astype(np.int64))


def start_weights(counts: Counts) -> Weights:
    """Biases are the unigrams, vectors small random ones."""
    rng = np.random.default_rng(11)
    share = np.concatenate([counts.top_counts + 1.0, counts.tail_tokens + 1.0])
    by_class = np.bincount(counts.classes_of(np.arange(counts.symbols)), weights=share)
    draw = lambda *shape: ((rng.random(shape) - 0.5) * 0.2).astype(np.float32)
    with_bias = lambda n, p: np.concatenate([draw(n, DIMENSIONS), np.log(p)[:, None]], axis=1).astype(np.float32)
    maps = np.tile(np.eye(DIMENSIONS, dtype=np.float32), (CONTEXT, 1, 1)) + draw(CONTEXT, DIMENSIONS, DIMENSIONS)
    inside = share[: counts.size] / by_class[np.arange(counts.size) // MEMBERS]
    parts = [draw(counts.symbols + 1, DIMENSIONS), maps, with_bias(len(by_class), by_class / by_class.sum()), with_bias(counts.size, inside)]
    return Weights(*parts, [np.full(x.shape[:-1], FIRST_SQUARE, np.float32) for x in parts])


def contexts(symbols: np.ndarray, offsets: np.ndarray, before: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """[tokens x CONTEXT]: the symbols before each token from start to stop, nearest first."""
    at = np.arange(start, len(symbols) if stop is None else min(stop, len(symbols)))
    begin = np.repeat(offsets[:-1], np.diff(np.clip(offsets, start, start + len(at))))
    out = np.full((len(at), CONTEXT), before, np.int64)
    for j in range(1, CONTEXT + 1):
        ok = at - j >= begin
        out[ok, j - 1] = symbols[at[ok] - j]
    return out


def predicted(mapped: list, context: np.ndarray) -> np.ndarray:
    """[tokens x d + 1]: the predicted vectors, and a one for the bias; mapped are the inputs by place."""
    h = np.ones((len(context), DIMENSIONS + 1), np.float32)
    h[:, :-1] = sum(x[context[:, j]] for j, x in enumerate(mapped))
    return h


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values; row numbers fit in 16 bits, which sort fast."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Noise-contrastive estimation of classes and of words in their classes, with Adagrad steps by row."""

    def __init__(self, weights: Weights, counts: Counts) -> None:
        self.weights, self.counts = weights, counts
        share = np.concatenate([counts.top_counts + 1.0, counts.tail_tokens + 1.0])
        self.classes = counts.classes_of(np.arange(counts.symbols))
        self.class_share = np.bincount(self.classes, weights=share) / share.sum()
        self.class_noise = (np.log(self.class_share) + np.log(CLASS_NOISE)).astype(np.float32)
        self.mass = np.concatenate([[0.0], np.cumsum(share[: counts.size])])
        self.low = self.mass[np.minimum(np.arange(counts.word_classes) * MEMBERS, counts.size)]
        self.high = self.mass[np.minimum((np.arange(counts.word_classes) + 1) * MEMBERS, counts.size)]
        inside = share[: counts.size] / (self.high - self.low)[np.arange(counts.size) // MEMBERS] if counts.size else share[:0]
        self.word_noise = (np.log(inside) + np.log(WORD_NOISE)).astype(np.float32)

    def _move(self, part: int, rows, grad: np.ndarray, size: int) -> None:
        grad = grad / np.float32(size)
        x, square = self.weights.parts[part], self.weights.squares[part]
        square[rows] += np.einsum("...i,...i->...", grad, grad) / np.float32(grad.shape[-1])
        x[rows] += RATE * grad / np.sqrt(square[rows])[..., None]

    def step(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        w, size, sigmoid = self.weights, len(target), lambda x: 1 / (1 + np.exp(-x))
        e = w.inputs[context]
        h = np.ones((size, DIMENSIONS + 1), np.float32)
        e, maps = e.reshape(size, -1), w.maps.reshape(-1, DIMENSIONS)
        h[:, :-1] = e @ maps
        # the class: noise is shared by the batch
        own = self.classes[target]
        noise = rng.choice(len(self.class_share), size=CLASS_NOISE, p=self.class_share)
        q_own, q_noise = w.classes[own], w.classes[noise]
        up = 1 - sigmoid(np.einsum("ij,ij->i", h, q_own) - self.class_noise[own])
        down = -sigmoid(h @ q_noise.T - self.class_noise[noise])
        back = up[:, None] * q_own + down @ q_noise
        moves = [(2, *_row_sums(np.concatenate([own, noise]), np.concatenate([up[:, None] * h, down.T @ h])))]
        # the word in its class: noise is shared by the batch's tokens of the class
        inner = np.flatnonzero(target < self.counts.size)
        if len(inner):
            inner = inner[np.argsort(own[inner].astype(np.uint16), kind="stable")]
            t, hi, c = target[inner], h[inner], own[inner]
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            present, where = c[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
            drawn = self.low[present][:, None] + (self.high - self.low)[present][:, None] * rng.random((len(present), WORD_NOISE))
            other = np.clip(np.searchsorted(self.mass, drawn, "right") - 1, (present * MEMBERS)[:, None], np.minimum((present + 1) * MEMBERS, self.counts.size)[:, None] - 1)
            q_t, q_o, noise_o = w.words[t], w.words[other], self.word_noise[other]
            groups = list(zip(first.tolist(), np.append(first[1:], len(t)).tolist()))
            z = np.empty((len(t), WORD_NOISE), np.float32)
            for n, (a, b) in enumerate(groups):
                np.matmul(hi[a:b], q_o[n].T, out=z[a:b])
            down = -sigmoid(z - noise_o[where])
            up = 1 - sigmoid(np.einsum("ij,ij->i", hi, q_t) - self.word_noise[t])
            pull, moved = up[:, None] * q_t, np.empty((len(groups), WORD_NOISE, DIMENSIONS + 1), np.float32)
            for n, (a, b) in enumerate(groups):
                pull[a:b] += down[a:b] @ q_o[n]
                np.matmul(down[a:b].T, hi[a:b], out=moved[n])
            back[inner] += pull
            moved = moved.reshape(-1, DIMENSIONS + 1)
            moves.append((3, *_row_sums(np.concatenate([t, other.ravel()]), np.concatenate([up[:, None] * hi, moved]))))
        back = back[:, :-1]
        grad_maps = (e.T @ back).reshape(w.maps.shape)
        grad_inputs = (back @ maps.T).reshape(-1, DIMENSIONS)
        moves.append((0, *_row_sums(context.ravel(), grad_inputs)))
        for part, rows, grad in moves:
            self._move(part, rows, grad, size)
        self._move(1, slice(None), grad_maps, size)

    def run(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        for at in range(0, len(target), BATCH):
            self.step(context[at : at + BATCH], target[at : at + BATCH], rng)


def _unpack(batch: pa.RecordBatch | pa.Table, row: int):
    """A block's arrays, without copies."""
    types = {"words": _U, "tail": np.uint8, "tokens": np.uint32, "offsets": np.int64}
    return {c: np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in types.items()}


def _deal_documents(counts_var, this_round: int, workers: int):
    def run(batches):
        """The symbols of this round's training documents."""
        counts = counts_var.value
        for batch in batches:
            for row in range(batch.num_rows):
                held = np.array(batch.column("held")[row].as_py(), bool)
                keys = np.array(batch.column("row_keys")[row].as_py(), np.int64)
                use = np.flatnonzero(~held & (keys.view(_U) % _U(ROUNDS) == _U(this_round)))
                if not len(use):
                    continue
                b = _unpack(batch, row)
                symbols = symbols_of(b["words"], b["tail"], counts).astype(np.uint16)
                worker = (keys[use].view(_U) // _U(ROUNDS) % _U(workers)).astype(np.int64)
                texts = [symbols[b["tokens"][b["offsets"][d] : b["offsets"][d + 1]]].tobytes() for d in use]
                yield pa.RecordBatch.from_arrays([pa.array(worker), pa.array(keys[use]), pa.array(texts, pa.binary())], names=["worker", "row_key", "symbols"])

    return run


def train_worker(texts: list[np.ndarray], start: Weights, counts: Counts, seed: int) -> Weights:
    """Weights after all tokens of the texts, about a quarter million at a time in random order."""
    weights = start.copy()
    trainer, rng = Trainer(weights, counts), np.random.default_rng(seed)
    sizes = np.array([len(t) for t in texts])
    group = np.cumsum(sizes) // (1 << 18)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        symbols = np.concatenate([texts[i] for i in own]).astype(np.int64)
        context = contexts(symbols, np.concatenate([[0], np.cumsum(sizes[own])]), counts.symbols)
        mixed = rng.permutation(len(symbols))
        trainer.run(context[mixed], symbols[mixed], rng)
    return weights


def _train(shared_var, this_round: int):
    def run(table: pa.Table) -> pa.Table:
        one_blas_thread()
        counts, start = shared_var.value
        table = table.sort_by([("row_key", "ascending")])
        worker = table.column("worker")[0].as_py()
        texts = [np.frombuffer(x, np.uint16) for x in table.column("symbols").to_pylist()]
        weights = train_worker(texts, start, counts, worker * ROUNDS + this_round)
        return pa.table({"worker": [worker], "seen": [float(sum(map(len, texts)))], "weights": pa.array([weights.to_bytes()], pa.binary())})

    return run


def _average(table: pa.Table) -> pa.Table:
    table = table.sort_by([("worker", "ascending")])
    seen = np.array(table.column("seen").to_pylist())
    flat = sum(np.frombuffer(w, np.float32).astype(np.float64) * (s / seen.sum()) for w, s in zip(table.column("weights").to_pylist(), seen))
    return pa.table({"worker": [table.column("worker")[0].as_py() // AVERAGED], "seen": [float(seen.sum())], "weights": pa.array([np.asarray(flat, np.float32).tobytes()], pa.binary())})


def train(blocks: DataFrame, counts: Counts, worker_tokens: int = WORKER_TOKENS) -> Weights:
    """The rounds; of each the driver gets one row, the averaged weights."""
    spark, weights = blocks.sparkSession, start_weights(counts)
    schema = "worker long, seen double, weights binary"
    workers = max(1, -(-counts.tokens // (ROUNDS * worker_tokens)))
    known = spark.sparkContext.broadcast(counts)
    for n in range(ROUNDS if counts.tokens else 0):
        dealt = blocks.select("held", "row_keys", "words", "tail", "tokens", "offsets").mapInArrow(_deal_documents(known, n, workers), "worker long, row_key long, symbols binary")
        shared = spark.sparkContext.broadcast((counts, weights))
        trained = materialize(dealt.groupBy("worker").applyInArrow(_train(shared, n), schema), "weights")
        left = workers
        while left > 1:
            averaged = materialize(trained.groupBy(F.floor(F.col("worker") / AVERAGED).alias("g")).applyInArrow(_average, schema), "weights")
            drop_table(trained)
            trained, left = averaged, -(-left // AVERAGED)
        row = trained.first()
        drop_table(trained)
        if row:
            weights = weights.like(np.frombuffer(row["weights"], np.float32))
        shared.unpersist()
    return weights


def _longest(rows: np.ndarray) -> float:
    """The square of the longest row's length."""
    return float(np.einsum("ij,ij->i", rows, rows).max(initial=0))


def _log_sums(h: np.ndarray, outputs: np.ndarray, target: np.ndarray, bounded: bool, step: int = 256) -> np.ndarray:
    """Log of the softmax of each row's target, by batched products that stay in the cache.

    bounded: no product is beyond 60, so exp can't overflow.
    """
    own, sums = np.empty(len(h), np.float64), np.empty(len(h), np.float64)
    turned, ones = np.ascontiguousarray(outputs.T), np.ones(len(outputs), np.float32)
    kept, at_row = np.empty((min(step, len(h)), len(outputs)), np.float32), np.arange(step)
    for at in range(0, len(h), step):
        z = kept[: len(h) - at]
        np.matmul(h[at : at + step], turned, out=z)
        if not bounded:
            z -= z.max(axis=1, keepdims=True)
        own[at : at + step] = z[at_row[: len(z)], target[at : at + step]]
        np.exp(z, out=z)
        sums[at : at + step] = z @ ones
    return own - np.log(sums)


def log_probabilities(weights: Weights, counts: Counts, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log of each symbol's probability after those before it, normalised over all symbols."""
    out = np.empty(len(symbols), np.float64)
    mapped = [weights.inputs @ m for m in weights.maps]
    outputs = max(_longest(weights.classes), _longest(weights.words))
    for at in range(0, len(symbols), SCORED):
        t = symbols[at : at + SCORED].astype(np.int64)
        h = predicted(mapped, contexts(symbols, offsets, counts.symbols, at, at + SCORED))
        own = counts.classes_of(t)
        # no product is beyond that of the longest vectors
        bounded = _longest(h) * outputs < 60.0**2
        part = _log_sums(h, weights.classes, own, bounded)
        order = np.argsort(own.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(own[order], np.arange(counts.word_classes + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[c] : cuts[c + 1]]
            part[rows] += _log_sums(h[rows], weights.words[c * MEMBERS : (c + 1) * MEMBERS], t[rows] - c * MEMBERS, bounded)
        out[at : at + SCORED] = part
    return out


def _score(shared_var):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """The scores of one block's documents; answers are its shards' counts."""
        one_blas_thread()
        counts, weights = shared_var.value
        unit = np.log10(counts.tokens + counts.words + 1.0)
        b = _unpack(block, 0)
        c = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in answers.sort_by("shard").column("counts")])
        kind = symbols_of(b["words"], b["tail"], counts)
        k = np.maximum(kind - counts.size, 0)
        inside = np.where(kind < counts.size, 0.0, np.log10(c + 1.0) - np.log10(counts.tail_tokens[k] + counts.tail_words[k] + 1.0))
        tokens, offsets = b["tokens"], b["offsets"]
        begin = offsets[:-1]
        added = lambda x: np.add.reduceat(x, begin)
        model = log_probabilities(weights, counts, kind.astype(np.uint16)[tokens], offsets)
        model /= np.log(10)
        model += inside[tokens]
        return pa.table(
            {
                "doc_id": block.column("doc_ids").combine_chunks().flatten(),
                "held_out": block.column("held").combine_chunks().flatten(),
                "n_tokens": pa.array(np.diff(offsets)),
                "n_known": pa.array(added((c > 0).astype(np.int64)[tokens])),
                "train_tokens": pa.array(np.full(len(begin), counts.tokens, np.int64)),
                "base_score": pa.array(added((np.log10(c + 1.0) - unit)[tokens])),
                "score": pa.array(added(model)),
            }
        )

    return run


def make_blocks(docs: DataFrame) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), held_out().alias("held_out"), F.xxhash64("doc_id", text).alias("row_key"))
    schema = f"block long, n_words long, doc_ids array<{id_type}>, held array<boolean>, row_keys array<long>, words binary, tail binary, counts binary, tokens binary, offsets binary"
    return materialize(rows.mapInArrow(_blocks, schema), "blocks", ROW_GROUP)


def count_words(blocks: DataFrame) -> DataFrame:
    """Each block's answers from the shards, and a row without a block for each shard."""
    entries = blocks.agg(F.sum("n_words")).first()[0] or 0
    shards = max(4, -(-entries // SHARD_ENTRIES))
    dealt = blocks.select("block", "words", "tail", "counts").mapInArrow(_deal(shards), "shard int, block long, words binary, tail binary, counts binary")
    schema = "shard int, block long, counts binary, top binary, sums array<struct<kind:string,at:int,n:long>>"
    return materialize(dealt.groupBy("shard").applyInArrow(_add_up, schema), "counts")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    docs needs doc_id and text (null: empty, which is the end token alone); other
    columns are ignored.  Rows with crc32(doc_id) mod 7 = 2 are held out; a null
    doc_id is not.  Repeated rows count and are scored as often as they occur.
    With nothing to learn from, all words are unseen ones of the tail classes.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    begin = mark(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks = make_blocks(docs)
    added = count_words(blocks)
    counts = gather_counts(added)
    weights = train(blocks, counts)
    release(spark, begin, (blocks, added))
    answers = added.where("block is not null").select("block", "shard", "counts")
    scored = blocks.select("block", "doc_ids", "held", "words", "tail", "tokens", "offsets")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # a group is one block: joined rows would be sent to Python many blocks at once
    return scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(spark.sparkContext.broadcast((counts, weights))), schema)
