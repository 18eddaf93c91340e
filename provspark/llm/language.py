"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased, everything but letters becomes a word border, and the
character 2-, 3- and 4-grams of the bordered words hash into a fixed number of
buckets.  The text's vector is the average of its buckets' embeddings and a
linear softmax reads the language off it.  Both are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  Since average
and softmax are linear up to the last step, prediction adds up per-bucket
logits, so a whole text costs a few vector operations per character.

Calibration: part of the sample is set aside; a temperature is fitted on it, and
the rejection threshold is placed below every right answer it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, text_bytes

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Parameters; the first four bound what the classifier is fitted on."""

    sample_rows: int = 1600  # dealt evenly to the languages
    least_rows: int = 16  # of a language, however many languages there are
    sample_text_points: int = 6_000  # code points of a sampled text; a longer one gives a crop at a hashed place
    most_languages: int = 1000  # the most frequent ones are learned
    buckets: int = 1 << 15
    dimensions: int = 16
    grams: tuple = (2, 3, 4)
    epochs: int = 24
    least_steps: int = 600  # a small sample takes more epochs
    batch: int = 32
    rate: float = 0.5
    crop: int = 64  # n-grams of a training crop: short texts are learned too
    seed: int = 7


@dataclass
class Model:
    languages: list
    logits: np.ndarray  # buckets x languages, float32
    temperature: float
    threshold: float
    settings: Settings


_U = np.uint64


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0; built from Unicode's categories."""
    import unicodedata

    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] == "L":
            lower = chr(point).lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


_table: np.ndarray | None = None


def letters() -> np.ndarray:
    global _table
    if _table is None:
        _table = _letters()
    return _table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the texts' offsets among them."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return points, before[offsets]


def gram_buckets(points: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[list, np.ndarray]:
    """For each n-gram size (bucket ids, the texts' offsets among them, mask of starts); letters per text."""
    n = len(offsets) - 1
    plain = letters()[np.minimum(points, 0x10FFFF)]
    # a border after each text keeps the n-grams of neighbours apart
    at = np.arange(len(points)) + np.repeat(np.arange(n), np.diff(offsets)) + 1
    symbols = np.zeros(len(points) + n + 1, np.uint32)
    symbols[at] = plain
    offsets = offsets + np.arange(n + 1)
    known = symbols != 0
    before = np.concatenate([[0], np.cumsum(known[1:])])
    out = []
    wide = symbols.astype(_U)
    for size in settings.grams:
        m = max(0, len(symbols) - size + 1)
        # inside one word and its borders: only the first and last may be borders
        inner = known[1 : 1 + m] if size > 2 else known[:m] | known[1 : 1 + m]
        for j in range(2, size - 1):
            inner = inner & known[j : j + m]
        h = np.full(m, size * 0x9E3779B1, _U)
        for j in range(size):
            h ^= wide[j : j + m]
            h *= _U(0x100000001B3)
        h = h[inner]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        ids = ((h >> _U(40)) % _U(settings.buckets)).astype(np.int32)
        out.append((ids, np.concatenate([[0], np.cumsum(inner)])[np.minimum(offsets, m)], inner))
    return out, before[offsets[1:]] - before[offsets[:-1]]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each segment's rows."""
    out = np.zeros((len(offsets) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0)
    return out


def text_logits(texts: pa.Array, table: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Average logits of each whole text, and its number of letters."""
    points, offsets = code_points(*text_bytes(texts))
    grams, n_letters = gram_buckets(points, offsets, settings)
    total = sum(_sums(table[ids], cuts) for ids, cuts, _ in grams)
    size = sum(np.diff(cuts) for _, cuts, _ in grams)
    return total / np.maximum(size, 1)[:, None], n_letters


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _grams_in_order(texts: list[str], settings: Settings, step: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams by text and place, and how many each text has; a few texts at a time."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at in range(0, len(texts), step):
        points, offsets = code_points(*text_bytes(pa.array(texts[at : at + step], pa.large_string())))
        grams, _ = gram_buckets(points, offsets, settings)
        place = np.concatenate([np.flatnonzero(inner) for _, _, inner in grams])
        parts.append(np.concatenate([i for i, _, _ in grams])[np.argsort(place, kind="stable")])
        sizes.append(sum(np.diff(c) for _, c, _ in grams))
    return np.concatenate(parts), np.concatenate(sizes)


def train(texts: list[str], labels: list[str], settings: Settings = Settings()) -> Model:
    """Stochastic gradient descent over random crops of the texts' n-grams."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(settings.seed)
    n_out = len(languages)
    if not languages:
        return Model([], np.zeros((settings.buckets, 0), np.float32), 1.0, 0.0, settings)
    y = np.array([languages.index(x) for x in labels])
    ids, size = _grams_in_order(texts, settings)
    cuts = np.concatenate([[0], np.cumsum(size)])
    usable = np.flatnonzero(size > 0)
    rng.shuffle(usable)
    held = usable[: len(usable) // 5] if len(usable) >= 50 else usable
    fit = usable[len(usable) // 5 :] if len(usable) >= 50 else usable
    # rare languages count as much as frequent ones
    weight = len(fit) / (n_out * np.maximum(np.bincount(y[fit], minlength=n_out), 1))
    table = (rng.random((settings.buckets, settings.dimensions)) - 0.5) / settings.dimensions
    seen = np.zeros(settings.buckets, bool)
    seen[ids] = True
    table[~seen] = 0  # an n-gram that was never seen says nothing
    out = np.zeros((settings.dimensions, n_out))
    epochs = max(settings.epochs, -(-settings.least_steps * settings.batch // max(1, len(fit))))
    for epoch in range(epochs if len(fit) else 0):
        rng.shuffle(fit)
        rate = settings.rate * (1 - epoch / epochs)
        for at in range(0, len(fit), settings.batch):
            rows = fit[at : at + settings.batch]
            length = np.minimum(size[rows], settings.crop)
            start = cuts[rows] + (rng.random(len(rows)) * (size[rows] - length + 1)).astype(np.int64)
            seg = np.repeat(np.arange(len(rows)), length)
            own = ids[np.arange(len(seg)) + np.repeat(start - (np.cumsum(length) - length), length)]
            mean = _sums(table[own], np.concatenate([[0], np.cumsum(length)])) / length[:, None]
            p = _softmax(mean @ out)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[y[rows]][:, None]
            back = p @ out.T / length[:, None]
            out -= rate * (mean.T @ p) / len(rows) * 8
            np.subtract.at(table, own, rate * back[seg])
    logits = (table @ out).astype(np.float32)
    z = np.array([logits[ids[cuts[i] : cuts[i + 1]]].mean(axis=0, dtype=np.float64) for i in held]).reshape(len(held), n_out)
    grid = np.geomspace(0.5, 5, 40)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-300)).mean() if len(held) else 0 for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature) if len(held) else np.zeros((0, n_out))
    right = p.argmax(axis=1) == y[held] if len(held) else np.zeros(0, bool)
    even = 1 / n_out
    lowest = float(p.max(axis=1)[right].min()) if right.any() else even
    threshold = min(even + 0.15, even + 0.5 * (lowest - even)) if n_out > 1 else 0.0
    return Model(languages, logits, temperature, threshold, settings)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Train on a sample of docs(doc_id, text, lang) with equal shares by language.

    Rows with a null or empty text or a null lang are no candidates.  Of each
    language the rows with the least hashes of doc_id and text are taken, so the
    sample does not depend on the partitioning; of a text longer than
    ``sample_text_points`` a crop is learned.  The sample holds at most
    ``sample_rows`` rows, or ``least_rows`` of each language if that is more.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.where(F.col("lang").isNotNull() & (F.length(text) > 0)).select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.most_languages).collect()}
    if not counts:
        return train([], [], settings)
    share = max(settings.least_rows, settings.sample_rows // len(counts))
    # about twice the share passes the filter; the exact share is taken of that
    limits = spark.createDataFrame([(k, min(1.0, (2.0 * share + 50) / n)) for k, n in counts.items()], "lang string, limit double")
    ticket = F.xxhash64("doc_id", "text")
    place = F.pmod(F.xxhash64(F.lit("crop"), "doc_id", "text"), F.greatest(F.length("text") - settings.sample_text_points, F.lit(0)) + 1).cast("int")
    few = rows.withColumn("ticket", ticket).join(F.broadcast(limits), "lang").where(F.shiftrightunsigned("ticket", 11) / float(1 << 53) < F.col("limit"))
    few = few.select("lang", "ticket", "doc_id", F.substring(F.col("text"), place + 1, F.lit(settings.sample_text_points)).alias("text"))
    order = Window.partitionBy("lang").orderBy("ticket", "doc_id", "text")
    sample = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= share).orderBy("ticket", "doc_id", "text", "lang").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample], settings)


def _kernel(model_var, keep):
    def run(batches):
        model = model_var.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                z, n_letters = text_logits(batch.column("text"), model.logits, model.settings)
                best, score = np.full(len(z), len(names) - 1), np.zeros(len(z))
                if model.languages:
                    p = _softmax(z / model.temperature)
                    best = np.where(n_letters > 0, p.argmax(axis=1), len(names) - 1)
                    score = np.where(n_letters > 0, p.max(axis=1), 0.0)
                rejected = (n_letters == 0) | (score < model.threshold)
                new = [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """lang_pred, score and rejected of every whole text, beside the columns in keep.

    A null text, or one without letters, is ``und`` with score 0 and rejected.
    So is every text if there was nothing to learn from.
    """
    model_var = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, rejected boolean"])
    rows = docs.select(*(c for c in keep if c != "text"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_kernel(model_var, keep), schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that the query's model may not learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = fit(rows.where(~F.col("held_out")))
    return predict(rows, model, ["doc_id", "held_out"])
