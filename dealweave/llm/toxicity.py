"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of its distinct words and their
beginnings; the document's is their noisy-or, 1 - prod(1 - p). Only document labels are needed: the gradient reaches the sentences
through the noisy-or, in proportion to what each contributes. The trained sentence scores locate what is offensive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.llm.language import held_out
from dealweave.llm.registry import query, read
from dealweave.llm.sampling import stratified

SAMPLE = 1500  # labelled documents of each class that the model may learn from
SIGMAS = 5.0  # a word gets a weight if its labels differ from all labels by so many standard deviations
ROUNDS = 300
DECAY = 1e-5  # L2
FLOOR = 0.02  # smaller weights are dropped after training

CACHED = 300_000  # words remembered by a worker

_sentence = re.compile(r"[^\n.!?]*(?:[.!?](?!\s)[^\n.!?]*)*[.!?]*\s?")
_words = re.compile(r"\w+").findall


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the sentences of a whole text: they end at a line end, or at . ! ? before white space."""
    at = 0
    while at < len(text):
        end = max(_sentence.match(text, at).end(), at + 1)
        yield at, end
        at = end


def parts(word: str) -> list[str]:
    """What can carry weight in a word: itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in range(4, 8) if n < len(word))]


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[str, float] = {}  # sums over the parts of the words seen so far

    def word(self, word: str) -> float:
        got = self.words.get(word)
        if got is None:
            if len(self.words) > CACHED:
                self.words.clear()
            got = self.words[word] = sum(self.weights.get(p, 0.0) for p in parts(word))
        return got

    @classmethod
    def fit(cls, rows: list[tuple[str, int, float]]) -> ToxicityModel:
        """Rows are text, label and weight of the document."""
        bags = [[[p for w in set(_words(t[a:b].lower())) for p in parts(w)] for a, b in sentences(t)] or [[]] for t, _, _ in rows]
        each = [set().union(*bag) for bag in bags]
        held, marked = Counter(w for ws in each for w in ws), Counter(w for ws, r in zip(each, rows) if r[1] for w in ws)
        rate = sum(r[1] > 0 for r in rows) / len(rows)
        spread = max(rate * (1 - rate), 1e-9)  # labels are noisy: rare words that happen to be marked stay out
        vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if abs(marked[w] - n * rate) >= SIGMAS * (n * spread) ** 0.5))}
        sent, word, doc = [], [], []
        for d, bag in enumerate(bags):
            for s in bag:
                known = [vocabulary[w] for w in s if w in vocabulary]
                word += known
                sent += [len(doc)] * len(known)
                doc.append(d)
        sent, word, doc = (np.array(x, dtype=np.int64) for x in (sent, word, doc))
        y = np.array([r[1] for r in rows], dtype=np.float64)
        weight = np.array([r[2] for r in rows], dtype=np.float64)
        weight /= weight.sum()
        x = np.zeros(len(vocabulary) + 1)
        x[-1] = -4.0
        m, v = np.zeros_like(x), np.zeros_like(x)
        for t in range(1, ROUNDS + 1):  # gradient descent with momentum and scaled steps
            z = np.clip(x[-1] + np.bincount(sent, x[word], minlength=len(doc)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.exp(np.bincount(doc, np.log1p(-p), minlength=len(rows)))
            any_ = np.maximum(1 - none, 1e-9)
            g = np.where(y > 0, -none / any_, 1.0) * weight
            gz = g[doc] * p
            grad = np.append(np.bincount(word, gz[sent], minlength=len(vocabulary)), gz.sum()) + DECAY * np.append(x[:-1], 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls({w: float(x[i]) for w, i in vocabulary.items() if abs(x[i]) >= FLOOR}, float(x[-1]))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a whole text and its sentences of at least 0.5."""
        found, none = [], 0.0
        for a, b in sentences(text):
            z = self.bias + sum(map(self.word, set(_words(text[a:b].lower()))))
            p = 1 / (1 + np.exp(-z)) if z > -30 else 0.0
            none += np.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                found.append((a, b, float(p)))
        return float(-np.expm1(none)) + 0.0, found  # no sentence: 0.0, not -0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Model from at most ``sample`` labelled rows of each class that are not held out, chosen by a hash of the id.

    Classes weigh as they do among all such labels. Null labels are none, of several labels of one id the largest holds;
    labels without a document and documents without a label are left out. Without any labelled document all scores are 0.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & F.col("_y").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["n"] for r in marks.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    picked = stratified(marks, "_y", "doc_id", sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").toArrow().to_pylist()  # at most sample rows a class
    rows = sorted({(str(r["doc_id"]), r["text"], r["_y"]) for r in rows})
    got = Counter(r[2] for r in rows)
    if not rows:
        return ToxicityModel({}, -100.0)
    return ToxicityModel.fit([(text, int(y > 0), share[y] / got[y]) for _, text, y in rows])


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, offending``: one row per input row, without a shuffle; ``offending`` holds start, end (code points)
    and score of the sentences of at least 0.5. Null text is empty and scores 0. Ids pass through; other columns are ignored."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.score(x.as_py()) for x in batch.column(1)]
            spans = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in g[1]] for g in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), spans], names=["doc_id", "score", "offending"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, score double, offending array<struct<start:int,end:int,score:double>>")


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return scored(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
