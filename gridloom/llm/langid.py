"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Trained on a bounded sample with follow-the-regularised-leader, one learning rate per weight, L1 and L2 penalties; the
model is the mean of the weights over all steps, and a temperature fitted on rows kept out of the training scales the
probabilities. The weights are a table of fixed size, so a prediction is one pass of table look-ups over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.words import carrying, mix, release_memory, row_slices, text_bytes
from gridloom.storage import broadcast_if_small, store

ORDERS = (1, 2, 3)
SLOTS = 1 << 16  # of features; a model of many languages merges neighbours
WEIGHTS = 1 << 22  # of all languages together, unless each would have fewer than LEAST_SLOTS
LEAST_SLOTS = 1 << 10
UNKNOWN = "und"


class Settings(NamedTuple):
    """``sample_rows`` bounds the training sample, in equal parts for each language and one row at least."""

    sample_rows: int = 4000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 100.0  # brings the TF-IDF values of a text, which sum to a few units, to gradients of order one


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # slots x languages: inverse document frequency times weight; the last slot weighs nothing
    bias: np.ndarray
    temperature: float


def _slots(points: np.ndarray, text_at: np.ndarray, order: int) -> np.ndarray:
    key = np.full(len(points), order, np.uint64)
    for k in range(order):
        key *= np.uint64(0x100000001B3)
        key[: len(points) - k] += points[k:]
    slots = (mix(key) >> np.uint64(48)).astype(np.int32)
    for k in range(1, order):
        ends = text_at[1:] - k
        slots[ends[ends >= text_at[:-1]]] = SLOTS
    return slots


class Grams(NamedTuple):
    """Code points of a run of texts: ``text_at`` bounds the texts, ``slots`` has one array per order."""

    text_at: np.ndarray
    slots: list[np.ndarray]
    spoken: np.ndarray  # the text has a letter


def grams(column: pa.Array) -> Grams:
    """Lower-cased code points; lower-casing is done text by text, as it may change the number of code points."""
    data, at = text_bytes(column)
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(at[:-1], at[1:])]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    text_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    spoken = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
    return Grams(text_at, [_slots(points, text_at, n) for n in ORDERS], spoken)


def text_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse term frequencies of each text: slots, and their share of all its grams."""
    found = grams(column)
    out = []
    for low, high in zip(found.text_at[:-1], found.text_at[1:]):
        slots = np.concatenate([s[low:high] for s in found.slots])
        used, counts = np.unique(slots[slots < SLOTS], return_counts=True)
        out.append((used, counts / max(counts.sum(), 1)))
    return out


def train_sample(df: DataFrame, key: Column, text: str, label: str, settings: Settings) -> DataFrame:
    """At most ``sample_rows`` labelled texts, the same number of each language where it has them; every one is learned.

    Chosen by a hash of ``key``, so the choice depends on neither order nor partitions: of the rows whose hash lies below
    a bound that a language's count sets, so that it leaves a few more than wanted, those of least hash. So no task ranks
    a whole language. Hashes alone are ranked; only chosen texts move.
    """
    rows = df.select(
        F.col(text).alias("text"),
        F.col(label).alias("lang"),
        F.xxhash64(key.cast("string")).alias("order"),
        F.xxhash64(text).alias("body"),
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    names = store(rows.groupBy("lang").agg(F.count("*").alias("of")), "languages")
    share = max(1, settings.sample_rows // max(1, names.count()))
    known = broadcast_if_small(names)
    few = (share + 6 * share**0.5 + 20) / F.col("of")  # a language falls short of its share once in 10**9
    near = rows.join(known, "lang").filter(F.col("order") / 2.0**64 + 0.5 <= few)
    rank = Window.partitionBy("lang").orderBy("order", "body")
    ranked = near.groupBy("lang", "order", "body").count().withColumn("rank", F.row_number().over(rank))
    chosen = ranked.filter(F.col("rank") <= share)
    chosen = broadcast_if_small(store(chosen.select("lang", "order", "body"), "chosen"))
    texts = rows.join(chosen, ["lang", "order", "body"], "left_semi")
    return texts.groupBy("lang", "order", "body").agg(F.first("text").alias("text")).select("text", "lang", "order")


def collect_features(sample: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Label, order and sparse features of the sample, in an order of their own; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                found = text_features(part.column("text"))
                slots = pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary())
                shares = pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("order"), slots, shares], ["lang", "order", "slots", "shares"]
                )

    rows = sample.mapInArrow(run, "lang string, order long, slots binary, shares binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["order"], r["lang"], r["slots"], r["shares"]))
    read = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    return [(r["lang"], i, s, v) for i, (r, (s, v)) in enumerate(zip(rows, read)) if len(s)]


def fit(rows: list[tuple[str, int, np.ndarray, np.ndarray]], settings: Settings = Settings()) -> Model:
    """Train on four fifths of the rows, fit the temperature on the rest. Without rows, no language is learned."""
    languages = sorted({lang for lang, *_ in rows})
    if not languages:
        return Model([], np.zeros((SLOTS + 1, 0), np.float32), np.zeros(0), 1.0)
    number = {lang: i for i, lang in enumerate(languages)}
    shift = slot_shift(len(languages))
    n_slots = SLOTS >> shift
    rows = [(lang, i, *_merged(slots >> shift, v)) for lang, i, slots, v in rows]
    held = [r for r in rows if r[1] % 5 == 4]
    learn = [r for r in rows if r[1] % 5 != 4] or rows
    frequency = np.zeros(n_slots, np.int64)
    for _, _, slots, _ in learn:
        frequency[slots] += 1
    idf = (np.log((1 + len(learn)) / (1 + frequency)) + 1) * settings.scale
    examples = [(number[lang], np.append(slots, n_slots), np.append(v * idf[slots], 1.0)) for lang, _, slots, v in learn]
    weights = _follow_leader(examples, len(languages), n_slots, settings, averaged=True)
    table = np.zeros((n_slots + 1, len(languages)), np.float32)
    table[:n_slots] = weights[:n_slots] * idf[:, None]
    model = Model(languages, table, weights[n_slots], 1.0)
    if not held:
        return model
    logits = np.array([v @ table[slots] + model.bias for _, _, slots, v in held])
    truth = np.array([number[lang] for lang, *_ in held])
    return model._replace(temperature=_temperature(logits, truth))


def slot_shift(n_languages: int) -> int:
    """Bits of the slot that a model of so many languages drops, so that its table stays within WEIGHTS."""
    shift = 0
    while (SLOTS >> shift) > LEAST_SLOTS and (SLOTS >> shift) * n_languages > WEIGHTS:
        shift += 1
    return shift


def _merged(slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending slots, equal ones added up."""
    first = np.flatnonzero(np.diff(slots, prepend=-1))
    return slots[first], np.add.reduceat(values, first) if len(first) else values


def _follow_leader(examples: list, n_classes: int, n_slots: int, settings: Settings, averaged: bool = False) -> np.ndarray:
    """FTRL-proximal: weights are the closed-form minimum of the gradients so far with both penalties.

    ``averaged`` gives the mean of the weights that the steps started from, in place of the last ones. When most texts
    are learned, only those that hold passages of another language still move the weights, and by much, as the rates
    shrink with the gradients alone; so the last weights lean to whichever of them came last, a whole language away.
    """
    z, n = np.zeros((n_slots + 1, n_classes)), np.zeros((n_slots + 1, n_classes))
    total, since, at = np.zeros((n_slots + 1, n_classes)), np.zeros(n_slots + 1), 0  # summed up to step ``since`` of a slot

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        pull = np.sign(z) * settings.l1 - z
        return np.where(np.abs(z) > settings.l1, pull / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2), 0)

    for _ in range(settings.epochs):
        for truth, slots, x in examples:
            w = weights(z[slots], n[slots])
            at += 1
            total[slots] += w * (at - since[slots])[:, None]
            since[slots] = at
            p = _softmax(x @ w)
            p[truth] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / settings.alpha
            z[slots] += g - step * w
            n[slots] += g * g
    if not averaged:
        return weights(z, n)
    return (total + weights(z, n) * (at - since)[:, None]) / max(at, 1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(truth)), truth]
        return -np.log(np.maximum(p, 1e-300)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def score_texts(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    found = grams(column)
    counts = np.diff(found.text_at)
    n = len(counts)
    logits = np.zeros((n, len(model.languages)))
    filled = np.flatnonzero(counts)
    total = np.zeros(n)
    shift = SLOTS.bit_length() - (len(model.table) - 1).bit_length()
    for slots in found.slots:
        if len(filled):
            logits[filled] += np.add.reduceat(model.table[slots >> shift], found.text_at[filled], axis=0, dtype=np.float64)
            total[filled] += np.add.reduceat((slots < SLOTS).astype(np.int64), found.text_at[filled])
    known = found.spoken & ~column.is_null().to_numpy(zero_copy_only=False)
    if not len(model.languages):
        return [UNKNOWN] * n, np.zeros(n)
    p = _softmax((logits / np.maximum(total, 1)[:, None] + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known)]
    return names, np.where(known, p[np.arange(n), best], 0.0)


def predict(df: DataFrame, key: str, text: str, model: Model, carry: Sequence[str] = ()) -> DataFrame:
    """``key``, the columns ``carry``, ``lang_pred`` and ``score`` of every row's whole text.

    NULL, and texts without a letter, are ``und`` with score 0; so is everything if no language was learned. Equal
    probabilities go to the smaller name. Keys may be NULL or repeated. Other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # WEIGHTS numbers, and LEAST_SLOTS for each further language
    source, carried = carrying(df, text, [key, *carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "_text"):
                names, score = score_texts(part.column("_text"), shared.value)
                arrays = [*map(part.column, carried), pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [key, *carry, "lang_pred", "score"])
        release_memory()

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [T.StructField(c, df.schema[c].dataType) for c in (key, *carry)]
    return source.mapInArrow(run, T.StructType([*kept, *fields]))
