"""A toxicity classifier, regularised by counterfactuals.

Logistic regression over the words of a text and the beginnings of its longer words (which catch compounds). Each labelled
text that names a group is also rewritten with the term swapped for others of its kind; besides the usual loss, the squared
change of the score is penalised, so what tips a text is what is said and not whom it mentions.

Learning takes at most ``per_class`` labelled documents of either label, the first by a hash of doc_id, joined to their whole
texts; executors bring each text down to its distinct words, which are all that counts, and only those come to the driver. The
intercept is then set back to the labels' own share. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import held, release, slices

#: Groups of terms that may stand for each other in a sentence.
IDENTITY = (
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists catholics", "muslim christian jewish hindu buddhist atheist catholic",
    "gay lesbian straight bisexual transgender", "black white asian latino arab african european", "immigrants refugees foreigners natives", "american mexican chinese indian german french spanish turkish polish",
    "old young disabled deaf blind", "frauen männer mädchen jungen", "muslime christen juden", "ausländer flüchtlinge einheimische", "femmes hommes filles garçons", "musulmans chrétiens juifs", "étrangers réfugiés immigrés",
    "mujeres hombres chicas chicos", "musulmanes cristianos judíos", "extranjeros refugiados inmigrantes",
)
PER_CLASS = 3000
#: Letters of a word that its own feature has, in learning and in scoring alike: an unbroken run of letters may have any length.
LEARN_CHARS = 8000
#: Features that are kept: the ones that tell the classes apart best, if they are in LEAST texts of the sample.
FEATURES = 6000
LEAST = 3
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of the penalty on score changes, and of the one on large weights.
COUNTERFACTUAL = 1.0
RIDGE = 5e-5
STEPS = 400
#: Words whose features a Python worker remembers.
MEMORY = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_KIN = {w: tuple(x for x in group.split() if x != w) for group in IDENTITY for w in group.split()}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def word_features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings, marked as such."""
    return (word[:LEARN_CHARS], *(word[:k] + "*" for k in PREFIXES if k < len(word)))


def features(words: list[str]) -> set[str]:
    return {f for w in set(words) for f in word_features(w)}


def distinct(text: str | None) -> str | None:
    """The distinct words of a text, which have its features and those of what it is swapped to."""
    return text if text is None else " ".join(dict.fromkeys(w[:LEARN_CHARS] for w in words_of(text)))


def swapped(words: list[str]) -> list[list[str]]:
    """The text once for each place in the kin of its terms: every term is swapped for its next, second next and so on."""
    most = max((len(_KIN[w]) for w in words if w in _KIN), default=0)
    return [[_KIN[w][k % len(_KIN[w])] if w in _KIN else w for w in words] for k in range(most)]


class Rows:
    """A sparse 0/1 matrix."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width = width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.fromiter((c for r in rows for c in r), np.int64, sum(map(len, rows)))
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def fit(texts: list[str | None], toxic: list[int], counterfactual: float = COUNTERFACTUAL, share: float | None = None) -> dict[str, float]:
    """Weights by feature, the intercept under the empty string. ``share``: of toxic texts, where ``texts`` has another."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        # One class only: its smoothed share is all there is to say.
        p = (y.sum() + 0.5) / (len(y) + 1)
        return {"": float(np.log(p / (1 - p)))}
    # Texts are cut into features twice rather than kept as such: the features of all would fill the driver's memory.
    seen = (Counter(), Counter())
    for t, label in zip(texts, toxic, strict=True):
        seen[label].update(features(words_of(t)))
    n = np.array([len(y) - y.sum(), y.sum()])
    least = min(LEAST, max(1, int(n.min() // 10)))
    names = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= least]
    names.sort()
    counts = np.array([[seen[0][f], seen[1][f]] for f in names], float).reshape(-1, 2)
    both = (counts.sum(axis=1) + 0.5) / (n.sum() + 1)
    z = np.abs(counts[:, 1] / n[1] - counts[:, 0] / n[0]) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    kept = [names[i] for i in np.argsort(-z, kind="stable")[:FEATURES] if z[i] >= 2]
    place = {f: i for i, f in enumerate(sorted({*kept, *(f for f in _KIN if seen[0][f] + seen[1][f] >= 1)}))}
    del seen, names
    placed = lambda words: [place[f] for f in features(words) if f in place]
    own, changed, origin = [], [], []
    for i, t in enumerate(texts):
        words = words_of(t)
        own.append(placed(words))
        for variant in swapped(words):
            changed.append(placed(variant))
            origin.append(i)
    x, other, origin = Rows(own, len(place)), Rows(changed, len(place)), np.array(origin, np.int64)
    w, b = np.zeros(len(place)), float(np.log(n[1] / n[0]))
    mean, var = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, STEPS + 1):
        raw = x.dot(w)
        off = 1 / (1 + np.exp(-np.clip(raw + b, -30, 30))) - y
        grad = x.back(off) / len(y) + RIDGE * w
        if len(origin):
            change = (raw[origin] - other.dot(w)) * (2 * counterfactual / len(origin))
            toward = np.bincount(origin, weights=change, minlength=len(y))
            grad += x.back(toward) - other.back(change)
        g = np.append(grad, off.mean())
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        move = 0.05 * mean / (1 - 0.9**step) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    if share is not None and 0 < share < 1:
        b += float(np.log(share / (1 - share)) - np.log(n[1] / n[0]))
    weights = {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-3}
    return weights | {"": b}


class Scorer:
    """Scores of texts; the weighted features of a word are looked up once."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def __call__(self, text: str | None) -> float:
        own = set()
        if len(self.known) > MEMORY:
            self.known.clear()
        for w in set(words_of(text)):
            f = self.known.get(w)
            if f is None:
                f = self.known[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                own.update(f)
        total = self.weights[""] + sum(map(self.weights.__getitem__, sorted(own)))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _scoring(weights, key: str, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(weights.value))
        for batch in slices(batches, "text"):
            found = pa.array([scorer(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.record_batch([found if n == name else batch.column(i) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return score


def score(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` (with a column text) and score, 0 to 1. Null and empty texts get what the intercept says."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    typed = docs.withColumn("score", F.lit(None).cast("double"))
    return typed.mapInArrow(_scoring(sent, uuid.uuid4().hex, "score"), typed.schema)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in slices(batches, "text"):
        yield pa.record_batch([batch.column("doc_id"), pa.array(map(distinct, batch.column("text").to_pylist()), pa.string())], names=["doc_id", "text"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict[str, float]:
    """Weights from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks 0 or 1.

    Documents labelled twice count once, as toxic if either says so; of rows that share a doc_id the first by text counts;
    labels without a document don't count. Without labels every text scores one half.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn, n = {}, []
    for label in (0, 1):
        own = marked.where(F.col("toxic") == label)
        n.append(own.count())
        drawn |= {x.doc_id: label for x in own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    if not drawn:
        return {"": 0.0}
    # At most 2 * per_class ids: a bounded list, so the texts are found by one scan.
    ids = docs.sparkSession.createDataFrame([(i,) for i in drawn], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = found.mapInArrow(_distinct, "doc_id long, text string").collect()
    rows.sort(key=lambda x: x.doc_id)
    return fit([x.text for x in rows], [drawn[x.doc_id] for x in rows], share=n[1] / sum(n))


def held_out(docs: DataFrame):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; learns from the labels that aren't held out."""
    weights = learn(docs, labels.where(~held_out(labels)))
    found = score(docs.select("doc_id", held_out(docs).alias("held_out"), "text"), weights)
    return found.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
