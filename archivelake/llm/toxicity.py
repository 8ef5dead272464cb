"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Features of a text are its words of letters in lower case and their prefixes of 3 to 7 letters, hashed, at levels of how
often they stand in it. The classifier is logistic. Its positives are confirmed toxic texts; the rest of the training texts are unlabelled, whatever
their label. The risk is corrected by the class prior p (the share of toxic rows among the labelled training rows):

    p * E_pos[loss(+)] + max(0, E_unl[loss(-)] - p * E_pos[loss(-)])

where the second term estimates the risk on negatives; a step in which it falls below zero goes back along its gradient.

Bounds, documented as parameters: the classifier is fitted on the ``positives`` and ``unlabelled`` texts with the lowest
seeded hashes of their ids (all of them where there are fewer); features need ``LEAST`` texts of that sample. Scoring covers
every row and every word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

POSITIVES, UNLABELLED = 2000, 5000
LEAST, DIMENSIONS = 4, 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose features a worker remembers.
WORDS = 60_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    from xxhash import xxh32_intdigest

    marks = [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if n <= len(word))]
    return [xxh32_intdigest(m.encode("utf-8", "surrogatepass")) % DIMENSIONS for m in marks]


#: A mark's levels: present; 2 and 4 times or more; at least once in 256 and in 64 words. Each turns the hash another way.
TURNS = tuple(0x9E379 * k & (DIMENSIONS - 1) for k in range(5))


class Features:
    """The distinct features of texts: words and prefixes, each at the levels that it reaches; of chosen ones only if they
    are given."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.memo: dict[str, tuple] = {}
        self.marks = None if chosen is None else np.logical_or.reduce([chosen[np.arange(DIMENSIONS) ^ t] for t in TURNS])

    def of_word(self, word: str) -> tuple:
        if (got := self.memo.get(word)) is None:
            got = tuple(f for f in word_features(word) if self.marks is None or self.marks[f])
            if len(self.memo) >= WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got

    def of(self, text: str | None) -> set[int]:
        words = _WORD.findall((text or "").lower())
        times: dict[int, int] = {}
        for word, n in Counter(words).items():
            for f in self.of_word(word):
                times[f] = times.get(f, 0) + n
        found, size = set(times), len(words)
        for f, n in times.items():
            if n >= 2:
                found.add(f ^ TURNS[1])
                if n >= 4:
                    found.add(f ^ TURNS[2])
            if 256 * n >= size:
                found.add(f ^ TURNS[3])
                if 64 * n >= size:
                    found.add(f ^ TURNS[4])
        return found


def sample(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ids with the lowest seeded hashes, most rows at the utmost: the same in every run."""
    return ids.select("doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most).distinct()


def features_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (a bounded sample: id, toxic, any) with the features of their texts as bytes; of rows that share an id, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("toxicity")
        known = Features()
        for batch in common.pieces(batches):
            found = [np.array(sorted(known.of(x.as_py())), np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "f", "toxic", "unlabelled"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.mapInArrow(run, "doc_id long, f binary, toxic boolean, unlabelled boolean").groupBy("doc_id").agg(F.min("f").alias("f"), F.first("toxic").alias("toxic"), F.first("unlabelled").alias("unlabelled"))


class Classifier:
    """weights by feature and a bias; weights are 0 outside the chosen features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.chosen = weights, bias, weights != 0

    def score(self, found: set[int]) -> float:
        z = self.bias + float(self.weights[list(found)].sum()) if found else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 300, rate: float = 0.02, decay: float = 1e-4, batch: int = 9000, sureness: float = 4.0, seed: int = 11) -> Classifier:
    """The classifier of least non-negative risk; without positives or unlabelled texts it scores the prior throughout."""
    prior = float(np.clip(prior, 1e-3, 0.999))
    none = Classifier(np.zeros(DIMENSIONS, np.float32), float(np.log(prior / (1 - prior))))
    if not positive or not unlabelled:
        return none
    return fit_rows(lambda: [*((r, True, False) for r in positive), *((r, False, True) for r in unlabelled)], len(positive), len(unlabelled), none, prior, epochs, rate, decay, batch, sureness, seed)


def fit_rows(rows: Callable[[], Iterable[tuple[np.ndarray, bool, bool]]], n_positive: int, n_unlabelled: int, none: Classifier, prior: float, epochs: int = 300, rate: float = 0.02, decay: float = 1e-4, batch: int = 9000, sureness: float = 4.0, seed: int = 11) -> Classifier:
    """fit() over rows (features, positive, unlabelled) that are read twice, to choose features and to keep those alone, and
    never held as they are."""
    p, u = (np.zeros(DIMENSIONS, np.int32) for _ in range(2))
    for r, toxic, other in rows():
        for held, mine in ((p, toxic), (u, other)):
            if mine:
                held[r] += 1  # a text has each feature once
    # a feature is kept if its share among positives is above that among all texts by more than chance
    often = np.nonzero(p >= LEAST)[0]
    a, b = (p[often] + 0.5) / (n_positive + 1), (u[often] + 0.5) / (n_unlabelled + 1)
    sure = np.abs(a - b) / np.sqrt(a * (1 - a) / n_positive + b * (1 - b) / n_unlabelled)
    chosen = often[(a > 1.5 * b) & (sure > sureness)]
    if not len(chosen):
        return none
    column = np.full(DIMENSIONS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    pos, unl = [], []
    for r, toxic, other in rows():
        c = column[r]
        c = c[c >= 0]
        if toxic:
            pos.append(c)
        if other:
            unl.append(c)
    w, bias, random = np.zeros(len(chosen)), none.bias, np.random.default_rng(seed)
    m, v, step = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0

    def forward(rows: list[np.ndarray]):
        flat, at = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        sums = np.concatenate([[0.0], np.cumsum(w[flat])])
        return flat, np.diff(at), 1 / (1 + np.exp(-np.clip(bias + sums[at[1:]] - sums[at[:-1]], -30, 30)))

    def gradient(flat: np.ndarray, counts: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(flat, np.repeat(slope, counts), len(w)), slope.sum())

    for _ in range(epochs):
        order = random.permutation(len(unl))
        for at in range(0, len(unl), batch):
            rows = [unl[i] for i in order[at : at + batch]]
            some = [pos[i] for i in random.integers(0, len(pos), min(len(pos), batch))]
            fp, cp, sp = forward(some)
            fu, cu, su = forward(rows)
            negative = -np.log1p(-su).mean() + prior * np.log1p(-sp).mean()
            on_negative = gradient(fu, cu, su / len(rows)) - gradient(fp, cp, prior * sp / len(some))
            if negative >= 0:
                g = gradient(fp, cp, prior * (sp - 1) / len(some)) + on_negative
            else:
                g = -on_negative
            g[:-1] += decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[chosen] = w
    return Classifier(weights, float(bias))


def remainder(folds: int = 5):
    """crc32(doc_id as text) mod folds; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 5) -> Classifier:
    """From rows outside the held-out fold alone. Null labels are no labels; an id with both labels is toxic."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    toxic = sample(known.filter("toxic = 1"), positives, seed).withColumn("toxic", F.lit(True))
    others = sample(docs.filter(F.col("doc_id").isNotNull() & (remainder() != 0)), unlabelled, seed + 1).withColumn("unlabelled", F.lit(True))
    ids = toxic.join(others, "doc_id", "full").fillna(False)
    found = features_of(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ids.withColumn("doc_id", F.col("doc_id").cast("long")))
    # one partition of them at a time comes to the driver, in the order of ids
    with common.scope(docs.sparkSession):
        held = common.stored(found, "toxicity-features")
        count = held.agg(F.count_if("toxic").alias("p"), F.count_if("unlabelled").alias("u")).first()
        prior = float(np.clip(prior or 0.0, 1e-3, 0.999))
        model = Classifier(np.zeros(DIMENSIONS, np.float32), float(np.log(prior / (1 - prior))))
        if count["p"] and count["u"]:
            rows = lambda: ((np.frombuffer(r["f"], np.int32), r["toxic"], r["unlabelled"]) for r in held.orderBy("doc_id").toLocalIterator())
            model = fit_rows(rows, count["p"], count["u"], model, prior)
    common.trim()
    return model


def score(docs: DataFrame, classifier: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with score (0 to 1, higher: toxic likelier; of empty and null texts too) and predicted (1
    from 0.5 on)."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    shown = docs.select(*keep, F.col("text").alias("_text"))
    schema = shown.drop("_text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("toxicity")
        model = held.value
        known = Features(model.chosen)
        for batch in batches:
            found = [model.score(known.of(x.as_py())) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array([int(x >= 0.5) for x in found], pa.int32())], [*keep, "score", "predicted"])

    return shown.mapInArrow(run, schema)


def clean(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score below 0.5."""
    held, at = docs.sparkSession.sparkContext.broadcast(classifier), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("toxicity")
        model = held.value
        known = Features(model.chosen)
        for batch in batches:
            yield batch.filter(pa.array([model.score(known.of(x.as_py())) < 0.5 for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")
