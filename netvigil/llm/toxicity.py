"""Toxicity of texts by multiple-instance learning: only documents are labelled, sentences score.

A document is a bag of sentences. Sentence s is offensive with probability
p_s = sigmoid(bias + sum of the weights of its words), and the document is toxic unless no
sentence is (noisy-or): P = 1 - prod(1 - p_s). The weight of a word is the sum of its own
and those of its beginnings, so that inflected and rare words share what was learned.
The log-likelihood of the document labels is raised by gradient steps (Adam) over all
training documents: each round every task adds up the gradient of its blocks, which are
encoded once and written to the shared folder, and at most ``TASKS`` vectors of fixed size
go to the driver. The trained model finds the sentences that offend, though none was
ever labelled.

Sentences end at . ! ? or a line break and are cut after 60 words; words are runs of
letters, lower-cased. A null or empty text is one sentence without words: its score is the
bias alone. The labels of a document given twice count as toxic if one of them says so;
labels without doc_id or without a mark are ignored; documents that share a labelled
doc_id are each trained on. Without any labelled document, or with one label only, the
weights stay 0 and every sentence scores the smoothed share of toxic documents. Repeated rows are
answered separately, an empty table gives no rows, other columns are carried along, and
ids, languages and sources are never seen by the model. Training takes at most
``MAX_LABELLED`` labelled documents, chosen by a hash of doc_id; it is deterministic up
to the order of floating-point sums.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.bytesets import groups
from netvigil.llm.common import ship, stored, uniform

FEATURES = 1 << 17
TASKS = 64  # of a round of training, whose documents are bounded in number
PREFIXES = (3, 4, 5, 6)
LONGEST = 60  # words of a sentence
ROUNDS = 40
STEP = 0.3
DECAY = 1e-4  # of half the squared weights, per document
DAMP = 1e-3  # a feature whose gradient is smaller, a rare one, takes smaller steps
BIAS = -5.0
MAX_LABELLED = 400_000
BLOCK = 4 << 20  # bytes of text encoded as one block
CACHED_WORDS = 200_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_END, _TEXT = -1, -2  # stand for the end of a sentence and of a text


def word_features(word: str) -> list[int]:
    """The word itself and its beginnings, hashed."""
    parts = [f"={word}"] + [f"<{word[:n]}" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(part.encode()) % FEATURES for part in parts]


@dataclass
class Bags:
    """Documents as sentences, sentences as words, each by its number of the next."""

    words: np.ndarray  # numbers of words, text after text
    sentence_words: np.ndarray  # words per sentence
    text_sentences: np.ndarray  # sentences per text, at least one


class Numbers(dict):
    """Words to numbers, given in order of appearance; ends of sentences have one of their own."""

    def __init__(self):
        super().__init__(dict.fromkeys(".!?\n", _END))
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.words)
        self.words.append(word)
        return at


def bags(texts: list[str | None], numbers: Numbers) -> Bags:
    found: list[int] = []
    for text in texts:
        found += [numbers[token] for token in _TOKEN.findall((text or "").lower())]
        found.append(_TEXT)
    tokens = np.array(found, np.int32)
    is_word = tokens >= 0
    words = tokens[is_word]
    owner = np.cumsum(tokens == _TEXT)[is_word]
    sentence = np.cumsum(~is_word)[is_word]
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    place = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
    begin = np.flatnonzero(place % LONGEST == 0)
    sizes = np.diff(np.append(begin, len(words)))
    per_text = np.bincount(owner[begin], minlength=len(texts))
    empty = np.flatnonzero(per_text == 0)
    before = np.cumsum(per_text)[empty]
    return Bags(words, np.insert(sizes, before, 0), np.maximum(per_text, 1))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups, some of which may be empty."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def logits(bag: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    """Per sentence, from weights per word."""
    return bias + _sums(weights[bag.words], bag.sentence_words)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def noisy_or(z: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, S) per document, P = 1 - exp(-S), S the sum over sentences of -log(1 - p)."""
    s = np.maximum(_sums(np.logaddexp(0, z), sizes), 1e-12)
    return -np.expm1(-s), s


class Encoded:
    """A block of labelled documents whose words are numbered, with the features of each word."""

    def __init__(self, bag: Bags, toxic: np.ndarray, feature: np.ndarray, sizes: np.ndarray):
        self.bag, self.toxic, self.feature, self.sizes = bag, toxic, feature, sizes

    @classmethod
    def of(cls, texts: list[str | None], toxic: list[int]) -> Encoded:
        numbers = Numbers()
        bag = bags(texts, numbers)
        features = [word_features(w) for w in numbers.words]
        return cls(
            bag,
            np.array(toxic, np.int64),
            np.array([f for fs in features for f in fs], np.int64),
            np.array([len(fs) for fs in features], np.int64),
        )

    def pack(self) -> list[bytes]:
        parts = (
            self.bag.words, self.bag.sentence_words, self.bag.text_sentences,
            self.toxic, self.feature, self.sizes,
        )
        return [part.astype(np.int32).tobytes() for part in parts]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Encoded:
        a = [np.frombuffer(part, np.int32) for part in parts]
        return cls(Bags(a[0], a[1], a[2]), a[3], a[4], a[5])

    def gradient(self, model: np.ndarray) -> np.ndarray:
        """Of the negative log-likelihood: by feature, then by bias; then the value itself."""
        bag = self.bag
        z = logits(bag, _sums(model[self.feature], self.sizes), model[-1])
        _, s = noisy_or(z, bag.text_sentences)
        slope = np.where(self.toxic == 1, -1 / np.expm1(np.minimum(s, 500)), 1.0)
        by_sentence = np.repeat(slope, bag.text_sentences) * _sigmoid(z)
        by_word = np.bincount(
            bag.words, np.repeat(by_sentence, bag.sentence_words), len(self.sizes)
        )
        out = np.zeros(FEATURES + 2)
        out[:FEATURES] = np.bincount(self.feature, np.repeat(by_word, self.sizes), FEATURES)
        out[FEATURES] = by_sentence.sum()
        out[-1] = np.where(self.toxic == 1, -np.log(-np.expm1(-s)), s).sum()
        return out


class Adam:
    """Steps of like size for rare and frequent features."""

    def __init__(self, model: np.ndarray, step: float):
        self.model, self.step, self.round = model, step, 0
        self.mean, self.square = np.zeros_like(model), np.zeros_like(model)

    def take(self, gradient: np.ndarray) -> None:
        self.round += 1
        self.mean = 0.8 * self.mean + 0.2 * gradient
        self.square = 0.95 * self.square + 0.05 * gradient**2
        mean = self.mean / (1 - 0.8**self.round)
        square = self.square / (1 - 0.95**self.round)
        self.model = self.model - self.step * mean / (np.sqrt(square) + DAMP)


def _constant(n: int, toxic: int) -> np.ndarray:
    """The model of a table with at most one kind of label."""
    model = np.zeros(FEATURES + 1)
    model[-1] = math.log((toxic + 0.5) / (n - toxic + 0.5)) if n else BIAS
    return model


def train_blocks(gradient, n: int, toxic: int, rounds: int = ROUNDS) -> np.ndarray:
    """``gradient`` gives the sum over all blocks for a model."""
    if toxic in (0, n):
        return _constant(n, toxic)
    start = np.zeros(FEATURES + 1)
    start[-1] = BIAS
    adam = Adam(start, STEP)
    for _ in range(rounds):
        total = gradient(adam.model)
        adam.take(total[:-1] / n + DECAY * np.append(adam.model[:-1], 0))
    return adam.model


_PARTS = ("words", "sentence_words", "text_sentences", "toxic", "feature", "sizes")


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of the labelled documents, or of about ``max_labelled`` labels of them.

    Their ids are at most that many numbers, so they are broadcast and no text is shuffled.
    """
    marked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    )
    n = marked.count()
    if n > max_labelled:
        marked = marked.where(uniform(F.lit("toxicity"), F.col("doc_id")) < max_labelled / n)
    ids = marked.select(F.col("doc_id").alias("labelled_id"), "label")
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("text", "label")


def train(
    docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED
) -> np.ndarray:
    """A weight per feature, then the bias, from (doc_id, text) and (doc_id, toxic)."""
    spark = docs.sparkSession
    ship(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for low, high in groups([len(t or "") for t in texts], BLOCK):
                parts = Encoded.of(texts[low:high], toxic[low:high]).pack()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array([p], pa.binary()) for p in parts],
                        pa.array([high - low], pa.int64()),
                        pa.array([sum(toxic[low:high])], pa.int64()),
                    ],
                    [*_PARTS, "n_docs", "n_toxic"],
                )

    kinds = ", ".join(f"{p} binary" for p in _PARTS) + ", n_docs bigint, n_toxic bigint"
    blocks = stored(
        training_rows(docs, labels, max_labelled).mapInArrow(encode, kinds), "toxicity-blocks"
    )
    n, toxic = blocks.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_toxic"), F.lit(0))
    ).first()

    def gradient(model: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(FEATURES + 2)
            for batch in batches:
                for parts in zip(*[batch.column(p).to_pylist() for p in _PARTS], strict=True):
                    total += Encoded.unpack(parts).gradient(shared.value)
            raw = total.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["numbers"])

        rows = blocks.select(*_PARTS).coalesce(TASKS).mapInArrow(run, "numbers binary").collect()
        found = sum(np.frombuffer(r["numbers"], np.float32).astype(np.float64) for r in rows)
        shared.unpersist()
        return found

    return train_blocks(gradient, n, toxic, rounds)


class Scorer:
    """Weights of words as they come up."""

    def __init__(self, model: np.ndarray):
        self.bias, self.model = float(model[-1]), model.tolist()
        self.numbers = Numbers()
        self.weights: list[float] = []

    def logits(self, texts: list[str | None]) -> tuple[Bags, np.ndarray]:
        if len(self.weights) > CACHED_WORDS:
            self.numbers, self.weights = Numbers(), []
        bag = bags(texts, self.numbers)
        model = self.model
        self.weights += [
            sum([model[f] for f in word_features(word)])
            for word in self.numbers.words[len(self.weights) :]
        ]
        return bag, logits(bag, np.array(self.weights, float), self.bias)


ADDED = ("score", "worst", "worst_probability")


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """``docs`` with its score, and the number (from 0) and probability of its worst sentence."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    carried = [c for c in docs.columns if c not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in groups([len(t or "") for t in texts], BLOCK):
                bag, z = scorer.logits(texts[low:high])
                found, _ = noisy_or(z, bag.text_sentences)
                ends = np.cumsum(bag.text_sentences)
                worst = np.array(
                    [int(np.argmax(z[e - n : e])) for e, n in zip(ends, bag.text_sentences, strict=True)],
                    np.int64,
                )
                top = z[ends - bag.text_sentences + worst]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[low:high],
                        pa.array(found),
                        pa.array(worst),
                        pa.array(_sigmoid(top)),
                    ],
                    ["row", *ADDED],
                )

    rows = docs.select("text", F.struct(*[F.col(c) for c in carried]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row {kind}, score double, worst bigint, worst_probability double"
    ).select("row.*", *ADDED)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in order, as they are numbered: words joined by spaces."""
    numbers = Numbers()
    bag = bags([text], numbers)
    words = [numbers.words[i] for i in bag.words]
    ends = np.cumsum(bag.sentence_words)
    return [" ".join(words[e - n : e]) for e, n in zip(ends, bag.sentence_words, strict=True)]


def offending(docs: DataFrame, model: np.ndarray, at_least: float = 0.5) -> DataFrame:
    """(row, at, sentence, probability): the sentences that offend, with the rest of their row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for i, text in enumerate(texts):
                p = _sigmoid(scorer.logits([text])[1])
                hit = np.flatnonzero(p >= at_least)
                found = sentences(text) if len(hit) else []
                out += [(i, int(k), found[k], float(p[k])) for k in hit]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array([o[0] for o in out], pa.int64())),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.float64()),
                ],
                ["row", "at", "sentence", "probability"],
            )

    rest = [c for c in docs.columns if c not in ("text", "at", "sentence", "probability")]
    rows = docs.select("text", F.struct(*[F.col(c) for c in rest]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"row {kind}, at bigint, sentence string, probability double"
    ).select("row.*", "at", "sentence", "probability")
