"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (n = 1 to 3, with one blank before, between and after words) in order of
frequency. A document's own list is held against each: an n-gram adds the distance between its two ranks, or the
profile's length if the language lacks it; the language with the smallest sum wins.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if there is no training text; otherwise the
score is one less the winner's distance over the largest possible one. Ties go to the language first in the alphabet.
Repeated rows count each; an empty table gives no rows; other columns are kept, but for those that are named as a result,
which takes their place. Whole texts are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .wordhash import slices

#: Training texts in all, about, chosen by a hash: the bound of the sample, unless ``LEAST`` of each language are more.
MAX_TRAIN = 20_000
#: Training texts that a language has at least, about, if it has so many; all of them, if it has fewer.
LEAST = 1_000
#: Length of a profile.
RANKS = 400

_U = np.uint64


def _letters() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (three code points of 21 bits each) and their counts, in n-gram order."""
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.zeros(len(points) + 2, np.uint64)
    low[1:-1] = _TABLE[0][np.minimum(points, 0x10FFFF)]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)  # one blank between words
    low = low[keep]
    one = low[low != 0]
    if not len(one):
        return one, one.astype(np.int64)
    two = (low[:-1] << _U(21)) | low[1:] | _U(1 << 63)
    three = (low[:-2] << _U(42)) | (low[1:-1] << _U(21)) | low[2:]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams first; ties in n-gram order."""
    if len(counts) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")][:ranks]


class Profiles:
    """``at``: an n-gram's rank in each language, in one table sorted by n-gram."""

    def __init__(self, by_language: dict[str, np.ndarray], ranks: int = RANKS):
        self.languages, self.ranks = sorted(by_language), ranks
        every = [by_language[x] for x in self.languages]
        self.grams = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.at = np.full((len(self.grams) + 1, len(every)), -1, np.int32)  # the last row: in no profile
        for i, grams in enumerate(every):
            self.at[np.searchsorted(self.grams, grams), i] = np.arange(len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ranked(*ngrams(text or ""), self.ranks)
        if not len(grams) or not self.languages:
            return "und", 0.0
        k = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        k[self.grams[k] != grams] = len(self.grams)
        at = self.at[k]
        distance = np.where(at < 0, self.ranks, np.abs(at - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (len(grams) * self.ranks))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, ranks: int = RANKS) -> Profiles:
    """Profiles of the languages of ``train``, from a sample of about ``max_train`` of its texts, dealt evenly to languages:
    of each about the same number, or all of its texts where there are fewer, whatever the size of the others."""
    known = train.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    each = max(LEAST, max_train // max(1, len(sizes)))
    large = [F.struct(F.lit(lang).alias("lang"), F.lit(int(each / n * (1 << 40))).alias("below")) for lang, n in sizes.items() if n > each]
    if large:
        shares = known.sparkSession.range(1).select(F.inline(F.array(*large)))
        below = F.coalesce("below", F.lit(1 << 40))
        known = known.join(F.broadcast(shares), "lang", "left").filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 40)) < below)
    sample = known.select("lang", "text")

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = total.setdefault(lang, {})
                grams, counts = ngrams(text)
                for g, n in zip(grams.view(np.int64).tolist(), counts.tolist(), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    lists: dict[str, list] = {}
    for r in counted.withColumn("rank", rank).filter(F.col("rank") <= ranks).orderBy("lang", "rank").collect():  # a profile a language
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles({k: np.array(v, np.int64).view(np.uint64) for k, v in lists.items()}, ranks)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, the input's columns first."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kept = [c for c in docs.columns if c not in names]
    read = [*kept, *([] if text_col in kept else [text_col])]

    def run(batches):
        for b in slices(batches):
            found = [shared.value.predict(t) for t in b.column(read.index(text_col)).to_pylist()]
            both = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *both], names=[*kept, *names])

    schema = StructType([*docs.select(*kept).schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.select(*read).mapInArrow(run, schema)
