"""Reading level of documents, by smoothed unigram language models, one per level.

The models are trained on the running text of labelled documents, cut into windows of words. A document's label is
only a first guess of its windows' levels: each round assigns every window its posterior level under the models of the
last round, with the label as the prior, and counts words again. All documents are then scored window by window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

LEVELS = 5
#: Words of a window at most, of one line and without regard to marks, which a text may lack.
WINDOW = 24
#: Labelled documents that the models are trained on at most, drawn by a hash of their ids. All words of these are words of
#: the models; that they are more than MOST_WORDS is an error, for which fewer documents are the remedy.
MAX_LABELLED, MOST_WORDS = 20_000, 2_000_000
#: Rounds of training, pseudo-count of each word, and how a label's weight is spread on itself and the levels beside it.
ROUNDS, ALPHA, NEAR = 3, 0.1, (0.7, 0.1, 0.03)
#: The share of letters from which a line is running text.
LETTERS = 0.6

#: A line of a log: a call and what came of it.
_CALL = re.compile(r"\s*\w+\([^()]*\)\s*(->|=>|:|$)").match
#: Words, and names with underscores or digits, which are no words.
_WORDS, _ODD, _NAME = re.compile(r"[^\W\d_]+").findall, re.compile(r"[\d_]").search, re.compile(r"\b[^\W\d_]*+[\d_]\w*")
#: Scripts without blanks between words: each character is a word.
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")


def running_text(text: str | None) -> tuple[list[str], list[int]]:
    """The words of the running text and the sizes of the windows that they fall into, line by line. Lines that are
    mostly something else than letters (logs, dumps, calls, tables of numbers) are no running text; names with
    underscores within a line don't count either way."""
    words: list[str] = []
    sizes: list[int] = []
    for line in (text or "").splitlines():
        if _CALL(line):
            continue
        line = line.lower()
        solid = len("".join(line.split()))
        plain = line
        if _ODD(line):
            solid -= sum(len(n) for n in _NAME.findall(line) if "_" in n)
            plain = _NAME.sub(" ", line)
        found = _WORDS(plain)
        if not found:
            continue
        letters = sum(map(len, found))
        if not line.isascii():
            letters += sum(c > "\x7f" and not c.isalpha() and not c.isspace() for c in line)
        if letters < LETTERS * solid:
            continue
        if not line.isascii() and _DENSE.search(line):
            found = [c for w in found for c in (w if _DENSE.search(w) else (w,))]
        n = len(found)
        size = -(-n // -(-n // WINDOW))
        words += found
        sizes += [size] * (n // size)
        if n % size:
            sizes.append(n % size)
    return words, sizes


class LevelModels:
    """Log probabilities of words per level."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        totals = counts.sum(0)
        log = np.log((counts + ALPHA) / (totals + ALPHA * max(len(words), 1)))
        self.log = np.vstack([log, np.zeros((1, LEVELS))])  # the last row is that of unknown words

    def scores(self, words: list[str], sizes: list[int]) -> np.ndarray:
        """The log likelihood per level of each window; words that weren't seen in training say nothing."""
        if not sizes:
            return np.zeros((0, LEVELS))
        ids = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(self.log[ids], starts, axis=0)

    @staticmethod
    def posterior(log_likelihood: np.ndarray, prior: np.ndarray | float = 1.0) -> np.ndarray:
        p = np.exp(log_likelihood - log_likelihood.max(1, keepdims=True)) * prior
        return p / p.sum(1, keepdims=True)


def priors(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, prior array<double>) of labels (doc_id, annotator, level), for at most max_labelled documents. Repeated
    rows count once, null and other levels not at all; annotators who disagree share the weight."""
    valid = labels.where(F.col("doc_id").isNotNull() & F.col("level").between(1, LEVELS)).select("doc_id", "annotator", "level").distinct()
    near = F.array(*(F.lit(x) for x in (*NEAR, 0.01, 0.01)))
    each = [F.avg(F.element_at(near, (F.abs(F.col("level") - k) + 1).cast("int"))).alias(str(k)) for k in range(1, LEVELS + 1)]
    means = valid.groupBy("doc_id").agg(*each).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    return means.select("doc_id", F.array(*map(str, range(1, LEVELS + 1))).alias("prior"))


def train(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> LevelModels:
    """Models from documents (doc_id, text) and labels. What is broadcast is bounded by max_labelled rows of a few
    numbers, what is collected by the words of these documents; without labels every level is as likely as any other."""
    labelled = documents.select("doc_id", "text").join(F.broadcast(priors(labels, max_labelled)), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, prior = [], []
            for text, p in zip(b.column("text").to_pylist(), b.column("prior").to_pylist()):
                flat, sizes = running_text(text)
                at = 0
                for n in sizes:
                    words.append(flat[at : at + n])
                    prior.append(p)
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(prior, pa.list_(pa.float64()))], ["words", "prior"])

    parts = cut(labelled.mapInArrow(split, "words array<string>, prior array<double>"))
    model = None
    for _ in range(max(1, rounds)):
        sent = None if model is None else documents.sparkSession.sparkContext.broadcast(model)

        def weigh(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words = b.column("words").to_pylist()
                weight = np.array(b.column("prior").to_pylist()).reshape(-1, LEVELS)
                weight = weight / weight.sum(1, keepdims=True)
                if sent is not None and len(words):
                    weight = LevelModels.posterior(sent.value.scores([w for ws in words for w in ws], list(map(len, words))), weight)
                place: dict[str, int] = {}
                ids = np.fromiter((place.setdefault(w, len(place)) for ws in words for w in ws), np.int64)
                each = np.repeat(weight, list(map(len, words)), axis=0) if words else weight
                table = np.stack([np.bincount(ids, each[:, k], len(place)) for k in range(LEVELS)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), *(pa.array(table[:, k]) for k in range(LEVELS))], ["word", *(f"c{k}" for k in range(LEVELS))])

        each = parts.mapInArrow(weigh, "word string, " + ", ".join(f"c{k} double" for k in range(LEVELS)))
        counts = each.groupBy("word").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(LEVELS)))
        rows = counts.limit(MOST_WORDS + 1).toPandas().sort_values("word")
        if len(rows) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words in {max_labelled} labelled documents")
        model = LevelModels(rows["word"].tolist(), np.round(rows[[f"c{k}" for k in range(LEVELS)]].to_numpy(np.float64).reshape(-1, LEVELS), 9))
    return model


def score(documents: DataFrame, model: LevelModels) -> DataFrame:
    """(doc_id, level, mean_level, hard_share, n_words) of documents (doc_id, text): the level of most of the running
    text's words, their mean level, and the share of them in windows of level 4 or 5 by posterior. A document without
    running text (null, empty, blank, logs, dumps) has null levels and 0 words. Repeated rows give a row each."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                words, sizes, owner = [], [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    w, s = running_text(text)
                    words += w
                    sizes += s
                    owner += [i] * len(s)
                mass = np.zeros((b.num_rows, LEVELS))
                if sizes:
                    np.add.at(mass, np.array(owner), m.posterior(m.scores(words, sizes)) * np.array(sizes, np.float64)[:, None])
                n = mass.sum(1)
                none = n == 0
                safe = np.where(none, 1, n)
                level, mean = mass.argmax(1) + 1, mass @ np.arange(1, LEVELS + 1) / safe
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(level.astype(np.int32), mask=none), pa.array(mean, mask=none), pa.array(mass[:, 3:].sum(1) / safe, mask=none), pa.array(np.rint(n).astype(np.int64))], ["doc_id", "level", "mean_level", "hard_share", "n_words"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int, mean_level double, hard_share double, n_words long")


def mostly_hard(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("hard_share") > 0.5)
