"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

Words are counted over all documents; the most frequent get a number of their own and the others share the remaining
numbers by hash. A word that shares its number has the number's probability times its own share of the number's
occurrences in all documents: with N of them, n / (N + 1) for a word that occurs n times; the one that is added is divided
evenly among all hashes a word that never occurs may have. So every word has a probability of its own. The ``LOCAL`` most
frequent words are looked up in a broadcast table and the others, each of which is rare, by a join with the counts of all
words, so nothing is left out at any size. The network sees the two words on either side of a place, through an embedding for each of the four
positions, and predicts the word there: first its class, then the word in its class, so a prediction costs two small
softmaxes. Training masks one place in ``MASK`` of every document, ``STEP`` of them in a step; all other words stand around
those. Each task trains from the same start on its documents, and the networks are averaged by their number of places, level by level, about ``FAN_IN`` in a task, so neither a
task nor the driver gathers what grows with the corpus. So the network depends on how documents are dealt to tasks, as
any average of parts does; counts don't. A document's score is the sum of the log-probabilities of all its words, each given
its neighbours on both sides.

Defined results: null and empty texts and texts without words have no tokens and a log-likelihood of 0; repeated rows
count and are scored each; an empty table gives no rows; other columns are ignored. Whole texts are read, in chunks of
``CHUNK`` places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .wordhash import long, mix, slices, stream, words

#: Word classes, and words of each; DIM: width of embeddings.
CLASSES, DIM, WINDOW, CHUNK = 64, 24, 2, 1 << 14
#: One place in MASK is masked in training; places that it learns from in one step.
MASK, STEP = 4, 4096
VOCABULARY = CLASSES * CLASSES
#: Numbers of frequent words; the other numbers are shared by hash.
FREQUENT = VOCABULARY - 1024
#: Words whose counts are broadcast, at most.
LOCAL = 1 << 20
#: Log of the part that each hash has in what is kept for words that never occur: a number has 2 ** 54 of all hashes.
UNSEEN = -np.log(2.0**64 / (VOCABULARY - FREQUENT))
#: Networks that are averaged in one task.
FAN_IN = 64
_U = np.uint64


@dataclass
class Network:
    embed: np.ndarray  # position, number, dim
    top: np.ndarray  # dim + 1, class
    low: np.ndarray  # class, dim + 1, word in class

    @staticmethod
    def start(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        shape = lambda *x: rng.normal(0, 0.1, x).astype(np.float32)
        return Network(shape(2 * WINDOW, VOCABULARY + 1, DIM), shape(DIM + 1, CLASSES) * 0.1, shape(CLASSES, DIM + 1, CLASSES) * 0.1)

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.top, self.low]

    def pack(self) -> bytes:
        return b"".join(x.astype("<f4").tobytes() for x in self.arrays())

    @staticmethod
    def unpack(data: np.ndarray) -> Network:
        own = Network.start()
        at = 0
        out = []
        for x in own.arrays():
            out.append(data[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        x = np.ones((len(around), DIM + 1), np.float32)
        total = self.embed[0][around[:, 0]]
        for p in range(1, 2 * WINDOW):
            total += self.embed[p][around[:, p]]
        x[:, :DIM] = np.tanh(total)
        return x

    def log_likelihood(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        x, (c, v) = self.hidden(around), np.divmod(target, CLASSES)
        y = x @ self.top
        out = y[np.arange(len(c)), c] - _log_sum(y)
        order = np.argsort(c, kind="stable")
        cut = np.searchsorted(c[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            own = order[cut[k] : cut[k + 1]]
            if len(own):
                y = x[own] @ self.low[k]
                out[own] += y[np.arange(len(own)), v[own]] - _log_sum(y)
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, seen: list[np.ndarray], rate: float = 0.1) -> None:
        """One Adagrad step on a batch."""
        x, (c, v) = self.hidden(around), np.divmod(target, CLASSES)
        n = len(target)
        d_top = _soft(x @ self.top)
        d_top[np.arange(n), c] -= 1
        d_x = d_top @ self.top.T
        order = np.argsort(c, kind="stable")
        cut = np.searchsorted(c[order], np.arange(CLASSES + 1))
        for k in range(CLASSES):
            own = order[cut[k] : cut[k + 1]]
            if len(own):
                d = _soft(x[own] @ self.low[k])
                d[np.arange(len(own)), v[own]] -= 1
                d_x[own] += d @ self.low[k].T
                g = x[own].T @ d / n
                seen[2][k] += g * g
                self.low[k] -= rate * g / np.sqrt(seen[2][k])
        g = x.T @ d_top / n
        seen[1] += g * g
        self.top -= rate * g / np.sqrt(seen[1])
        d_in = d_x[:, :DIM] * (1 - x[:, :DIM] ** 2) / n
        for p in range(2 * WINDOW):
            order = np.argsort(around[:, p], kind="stable")
            rows, begins = np.unique(around[order, p], return_index=True)
            g = np.add.reduceat(d_in[order], begins, axis=0)
            seen[0][p, rows] += (g * g).mean(axis=1)
            self.embed[p, rows] -= rate * g / np.sqrt(seen[0][p, rows])[:, None]


def _log_sum(y: np.ndarray) -> np.ndarray:
    top = y.max(axis=1)
    return top + np.log(np.exp(y - top[:, None]).sum(axis=1))


def _soft(y: np.ndarray) -> np.ndarray:
    e = np.exp(y - y.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Numbers:
    """Words' numbers: frequent ones their own, others by hash; VOCABULARY stands outside a text.

    ``local``: words that are looked up here, in order, and ``n``, their occurrences; ``totals``: occurrences of all words of
    each shared number; ``complete``: whether all words that occur are in ``local``."""

    def __init__(self, frequent: np.ndarray):
        self.keys = np.sort(frequent)
        self.local, self.n = np.empty(0, np.uint64), np.empty(0)
        self.totals = np.zeros(VOCABULARY - FREQUENT)
        self.complete = True

    def shares(self, h: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of each word's share of its number, and whether its count is to be looked up elsewhere and added to that."""
        out, away = np.zeros(len(h)), np.zeros(len(h), bool)
        at = np.flatnonzero(numbers >= FREQUENT)
        word = h[at]
        k = np.searchsorted(self.local, word)
        here = np.zeros(len(at), bool)
        inside = np.flatnonzero(k < len(self.local))
        here[inside] = self.local[k[inside]] == word[inside]
        own = np.full(len(at), UNSEEN if self.complete else 0.0)
        own[here] = np.log(self.n[k[here]])
        out[at] = own - np.log(self.totals[numbers[at] - FREQUENT] + 1)
        if not self.complete:
            away[at[~here]] = True
        return out, away

    def of(self, h: np.ndarray) -> np.ndarray:
        other = FREQUENT + (mix(h) % _U(VOCABULARY - FREQUENT)).astype(np.int64)
        if not len(self.keys):
            return other
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[k] == h, k, other)


def neighbourhoods(numbers: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers around each place of a batch of texts, VOCABULARY beyond a text's ends."""
    doc = np.searchsorted(first, at, "right")
    low, high = first[doc - 1], first[doc]
    out = np.empty((len(at), 2 * WINDOW), np.int64)
    for p, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        there = at + d
        ok = (there >= low) & (there < high)
        out[:, p] = np.where(ok, numbers[np.where(ok, there, at)], VOCABULARY)
    return out


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): hashes of all words of all documents and their numbers of occurrences."""

    def run(batches):
        for b in slices(batches, 4096):
            keys, n = np.unique(words(b.column(0), "space").hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(long(keys)), pa.array(n)], names=["word", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def number_words(counts: DataFrame) -> Numbers:
    """The numbers of the words that ``count_words`` counted, with what is looked up without a join."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    numbers = Numbers(np.array([r.word for r in top], np.int64).view(np.uint64))
    own = counts.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        total = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            np.add.at(total, own.value.of(b.column(0).to_numpy().view(np.uint64)), b.column(1).to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["number", "n"])

    for r in counts.mapInArrow(run, "number long, n long").filter(F.col("number") >= FREQUENT).groupBy("number").agg(F.sum("n").alias("n")).collect():  # the shared numbers
        numbers.totals[r.number - FREQUENT] = r.n
    # The least count at which no more than LOCAL words are looked up without a join; there are few different counts.
    least, size = None, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        if size + r.words > LOCAL:
            numbers.complete = False
            break
        least, size = r.n, size + r.words
    if least is not None:
        table = counts.filter(F.col("n") >= least).select("word", "n").toArrow()  # at most LOCAL rows
        word = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        numbers.local, numbers.n = word[order], table.column("n").to_numpy()[order].astype(np.float64)
    return numbers


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Numbers, Network, DataFrame]:
    """The words' numbers, the averaged network and the counts of all words."""
    counts = materialize(count_words(docs, text_col), "words")
    numbers = number_words(counts)
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches):
        own, places = Network.start(), 0
        seen = [np.full((2 * WINDOW, VOCABULARY + 1), 1e-4, np.float32), *(np.full(x.shape, 1e-4, np.float32) for x in own.arrays()[1:])]
        for b in slices(batches):
            w = words(b.column(0), "space")
            num = shared.value.of(w.hash)
            at = np.flatnonzero(mix(w.hash ^ mix(np.arange(len(num), dtype=np.uint64))) % _U(MASK) == 0)
            for some in np.array_split(at, -(-len(at) // STEP)) if len(at) else ():
                own.learn(neighbourhoods(num, w.first, some), num[some], seen)
            places += len(at)
        if places:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([places], pa.int64()), pa.array([own.pack()], pa.binary())], names=["salt", "places", "weights"])

    def average(key, table):
        total, n = 0.0, 0
        for places, weights in zip(table.column("places").to_pylist(), table.column("weights"), strict=True):
            total = total + np.frombuffer(weights.as_py(), "<f4") * np.float64(places)
            n += places
        return pa.table({"salt": pa.array([0], pa.int32()), "places": pa.array([n], pa.int64()), "weights": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    schema = "salt int, places long, weights binary"
    each = materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(run, schema), "networks")
    n = each.count()
    while n > FAN_IN:  # levels of averages, each group of about FAN_IN networks
        n = -(-n // FAN_IN)
        each = materialize(each.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).groupBy("salt").applyInArrow(average, schema), "networks")
    row = each.withColumn("salt", F.lit(0)).groupBy("salt").applyInArrow(average, schema).first()
    return numbers, Network.unpack(np.frombuffer(row.weights, "<f4")) if row else Network.start(), counts


def score(docs: DataFrame, model: tuple[Numbers, Network, DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token (log_likelihood / n_tokens, null without tokens)."""
    *own_model, counts = model
    shared = docs.sparkSession.sparkContext.broadcast(own_model)

    def run(batches):
        numbers, network = shared.value
        for b in slices(batches):
            w = words(b.column(1), "space")
            num = numbers.of(w.hash)
            share, away = numbers.shares(w.hash, num)
            total = np.zeros(b.num_rows)
            for lo in range(0, len(num), CHUNK):
                at = np.arange(lo, min(len(num), lo + CHUNK))
                own = network.log_likelihood(neighbourhoods(num, w.first, at), num[at]) + share[at]
                total += np.bincount(np.searchsorted(w.first, at, "right") - 1, weights=own, minlength=b.num_rows)
            away = np.flatnonzero(away)
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(away, w.first).astype(np.int32)), pa.array(long(w.hash[away])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.first)), pa.array(total), rest], names=["doc_id", "n_tokens", "log_likelihood", "rest"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, rest array<long>")
    if not own_model[0].complete:
        # The counts of the other words. Rows are numbered once, in the table that both sides read.
        found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = found.select("row", F.explode("rest").alias("word"))
        more = rare.join(counts.hint("merge"), "word", "left").groupBy("row").agg(F.sum(F.coalesce(F.log(F.col("n").cast("double")), F.lit(float(UNSEEN)))).alias("more"))
        found = found.drop("rest").join(more.hint("merge"), "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return found.select(F.col("doc_id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("per_token"))
