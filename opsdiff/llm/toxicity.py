"""Toxicity: a linear classifier with counterfactual regularisation.

Features are the words of a text and their beginnings (4 to 8 bytes), present or not, in
a table of fixed size.  The weights minimise the logistic loss, an L1 term that leaves only
telling features, and a counterfactual term: in every labelled text that names a group of
people the name is swapped for another of the same kind, and the square of the change of
the score (before the logistic function) is added.  A group's name therefore weighs as much
as any other group's, and does not make a neutral sentence toxic.

The training sample is bounded in rows, chosen by a hash of the id.  Every document is
scored where it is read; nothing is shuffled but the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsdiff.llm import hashing
from opsdiff.llm.common import slices, stored

SAMPLE_ROWS = 20_000
BITS = 20
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
# Names of people's groups that may stand for each other.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"), ("africans", "europeans", "asians", "americans"),
    ("african", "european", "american"), ("immigrants", "refugees", "natives"),
    ("blind", "deaf", "disabled"), ("old", "young"),
)


@dataclass(frozen=True)
class Model:
    places: np.ndarray   # features that weigh something, sorted
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column, parts: int = 4, held: int = 2) -> Column:
    """Rows whose labels are not for training; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == held, F.lit(False))


def features(text: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature place), sorted by row; only: the places asked for."""
    found = hashing.words(text, hashing.LETTERS, latin=True)
    with np.errstate(over="ignore"):
        kinds = [found.hash]
        for n in BEGINNINGS:
            kinds.append(hashing.mix(found.stretch(found.start, np.minimum(found.start + n, found.end)) + np.uint64(n)))
    places = np.concatenate(kinds) >> np.uint64(64 - BITS)
    row = np.tile(found.row, len(kinds))
    if only is not None:
        asked = only[places.astype(np.int64)]
        row, places = row[asked], places[asked]
    key = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | places)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def swapper(terms: tuple[tuple[str, ...], ...]):
    """A function that puts the next name of the same kind for each name in a text."""
    following = {}
    for kind in terms:
        for a, b in zip(kind, (*kind[1:], kind[0]), strict=True):
            following.setdefault(a.lower(), b)
    if not following:
        return lambda text: text
    pattern = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, following), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
    return lambda text: pattern.sub(lambda m: following[m[0].lower()], text)


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
                  terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> DataFrame:
    """toxic, features, gone, added of the bounded sample; the last two say what a swap changes.

    A label that is null is none; of several labels of a document the greatest counts.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def extract(batches):
        swap = swapper(terms)
        for part in hashing.parts(batches, 1):
            text = part.column(1)
            n = len(part)
            row, place = features(text)
            changed = pa.array([None if t is None or (s := swap(t)) == t else s for t in text.to_pylist()], pa.string())
            touched = np.flatnonzero(changed.is_valid().to_numpy(zero_copy_only=False))
            other_row, other = features(changed)
            of_touched = np.isin(row, touched)
            old = (row[of_touched] << BITS) | place[of_touched]
            new = (other_row << BITS) | other
            lists = [hashing.lists(row, place.astype(np.int32), n, pa.int32())]
            for keys in (np.setdiff1d(old, new), np.setdiff1d(new, old)):
                lists.append(hashing.lists(keys >> BITS, (keys & ((1 << BITS) - 1)).astype(np.int32), n, pa.int32()))
            yield pa.record_batch([part.column(0), *lists], names=["toxic", "features", "gone", "added"])

    return texts.mapInArrow(extract, "toxic int, features array<int>, gone array<int>, added array<int>")


def telling_features(sample: DataFrame, least: int = 6, away: float = 1.5) -> np.ndarray:
    """For each place whether the model may use it.

    Features of fewer than `least` texts are left out, and those whose share of toxic texts is less
    than `away` standard deviations from the mean's.  At most 2**BITS rows come to the driver.
    """

    def count(batches):
        every, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            place = batch.column(1).flatten().to_numpy()
            label = np.repeat(batch.column(0).to_numpy(), np.asarray(batch.column(1).value_lengths()))
            every += np.bincount(place, minlength=1 << BITS)
            toxic += np.bincount(place[label > 0], minlength=1 << BITS)
        found = np.flatnonzero(every)
        yield pa.record_batch([pa.array(found), pa.array(every[found]), pa.array(toxic[found])], names=["place", "n", "toxic"])

    counts = sample.select("toxic", "features").mapInArrow(count, "place long, n long, toxic long")
    counts = counts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least)
    counts = counts.select(*[F.col(c).cast("int") for c in ("place", "n", "toxic")]).toArrow()  # of a sample's rows and 2**BITS places
    mean = sample.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("m")).first()["m"] or 0.0
    place, n, toxic = (counts[c].to_numpy().astype(np.int64) for c in ("place", "n", "toxic"))
    far = np.abs(toxic - n * mean) / np.sqrt(np.maximum(n * mean * (1 - mean), 1e-9))
    out = np.zeros(1 << BITS, bool)
    out[place[far >= away]] = True
    return out


def _pairs(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table[column].combine_chunks()
    return np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def fit(sample: pa.Table, l1: float = 2e-4, counterfactual: float = 1.0, rounds: int = 150) -> Model:
    """Accelerated proximal gradient descent over the sample's telling features, on the driver.

    Without any label the score is 1/2, with labels of one kind alone it is near that kind.
    """
    toxic = (sample["toxic"].to_numpy() > 0).astype(float)
    n = len(toxic)
    if n == 0:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    row, place = _pairs(sample, "features")
    gone, added = _pairs(sample, "gone"), _pairs(sample, "added")
    del sample  # the driver holds each feature of the sample once
    seen = np.zeros(1 << BITS, bool)
    for places in (place, gone[1], added[1]):
        seen[places] = True
    used = np.flatnonzero(seen)
    width = len(used)
    col = np.searchsorted(used, place)
    del place, seen
    # What a swap takes (-1) and adds (+1); each text that names a group is one term.
    d_row, d_col = np.concatenate([gone[0], added[0]]), np.searchsorted(used, np.concatenate([gone[1], added[1]]))
    d_sign = np.concatenate([-np.ones(len(gone[0])), np.ones(len(added[0]))])
    _, d_row = np.unique(d_row, return_inverse=True)
    pairs = int(d_row.max()) + 1 if len(d_row) else 0
    share = (toxic.sum() + 0.5) / (n + 1)
    w, bias = np.zeros(width), float(np.log(share / (1 - share)))
    # A step for each feature that its own curvature allows.
    filled = np.bincount(row, minlength=n).astype(float)
    curve = 0.25 * np.bincount(col, filled[row], minlength=width) / n
    if pairs:
        wide = np.bincount(d_row, minlength=pairs).astype(float)
        curve = curve + 2 * counterfactual * np.bincount(d_col, wide[d_row], minlength=width) / pairs
    step = 1 / np.maximum(curve, 0.02)
    at, at_bias, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        z = np.bincount(row, at[col], minlength=n) + at_bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        gradient = np.bincount(col, error[row], minlength=width) / n
        if pairs:
            change = np.bincount(d_row, d_sign * at[d_col], minlength=pairs)
            gradient += 2 * counterfactual * np.bincount(d_col, d_sign * change[d_row], minlength=width) / pairs
        moved = at - step * gradient
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        moved_bias = at_bias - 4.0 * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_bias = moved + (t - 1) / t_new * (moved - w), moved_bias + (t - 1) / t_new * (moved_bias - bias)
        w, bias, t = moved, moved_bias, t_new
    some = np.flatnonzero(w)
    pa.default_memory_pool().release_unused()
    return Model(used[some], w[some], float(bias))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS,
          terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, least: int = 6, **how) -> Model:
    """Fits on labels(doc_id, toxic) of documents(doc_id, text) that are not held out."""
    sample = stored(training_rows(documents, labels, rows, terms), "toxic-sample")
    mask = telling_features(sample, least)

    def telling(batches):
        for batch in batches:
            out = [batch.column(0)]
            for c in (1, 2, 3):
                lists = batch.column(c)
                row = np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths()))
                place = lists.flatten().to_numpy(zero_copy_only=False)
                out.append(hashing.lists(row[mask[place]], place[mask[place]], len(batch), pa.int32()))
            yield pa.record_batch(out, names=["toxic", "features", "gone", "added"])

    # A bounded number of rows, and of each only what the model may use.
    return fit(sample.mapInArrow(telling, sample.schema).toArrow(), **how)


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic; a null text counts as empty and gets the bias alone."""
    places, weights, bias = model.places, model.weights, model.bias

    def scores(texts: pa.Array) -> pa.Array:
        out = []
        whole = np.zeros(1 << BITS)
        whole[places] = weights
        telling = whole != 0
        for part in slices(pa.record_batch([texts], names=["text"]), 0, hashing.BATCH_BYTES):
            row, place = features(part.column(0), telling)
            z = np.bincount(row, whole[place], minlength=len(part)) + bias
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return F.arrow_udf(scores, "double")(text)
