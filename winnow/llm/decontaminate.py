"""Benchmark decontamination by a prefix-filtered join of word shingles.

Each benchmark item gives windows of ``size`` words; a window is the set of its placed three-word shingles. Shingles are
ordered by rarity, counted over all documents; as a window has to be contained whole, its rarest shingle alone is the
necessary prefix. Documents are joined with the prefixes; an occurrence fixes where the window must begin, which has to
lie inside the document (positional bound) with all of its words (length bound), and what remains is verified word by
word. Windows are a stated query set: they are taken in blocks of at most ``BLOCK``, which bounds what is broadcast, and
each block meets all rows of the documents.

Defined results: null and empty texts have no words and are not contaminated; items without words have no windows; items
of fewer than ``size`` words are one window; repeated items count once by id; an item with a null id marks words but is
not listed; an empty benchmark leaves every document clean; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import materialize
from .wordhash import lists, long, shingles, slices, words

_U = np.uint64
BLOCK = 100_000
SHINGLE = 3


def windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """item (as text) and word hashes of every different window."""

    def cut(batches):
        for b in slices(batches):
            w = words(b.column(1), "alnum")
            items, found = [], []
            for i, item in enumerate(b.column(0).to_pylist()):
                h = w.of(i)
                n = min(size, len(h))
                for at in range(len(h) - n + 1 if n else 0):
                    items.append(item)
                    found.append(long(h[at : at + n]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), lists(found, pa.int64())], names=["item", "words"])

    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "item string, words array<long>").distinct()


class Block:
    """Windows of one block with their shingles; ``choose`` fixes each window's prefix once shingles have been counted."""

    def __init__(self, items: list, found: list):
        self.items = sorted({x for x in items if x is not None})
        number = {x: i for i, x in enumerate(self.items)}
        self.item = np.array([number.get(x, -1) for x in items], np.int64)
        self.length = np.array([len(x) for x in found], np.int64)
        self.words = np.zeros((len(found), max(self.length, default=1)), np.uint64)
        for i, x in enumerate(found):
            self.words[i, : len(x)] = np.array(x, np.int64).view(np.uint64)
        self.each = [shingles(self.words[i, :n], SHINGLE) for i, n in enumerate(self.length)]
        self.keys = np.unique(np.concatenate(self.each)) if found else np.empty(0, np.uint64)
        self.widths = sorted({min(SHINGLE, int(n)) for n in self.length})
        self._mark()

    def _mark(self) -> None:
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> _U(42)).astype(np.int64)] = True

    def find(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in a batch of documents, and the number of the shingle that is there."""
        at, which = [], []
        for width in self.widths if len(self.keys) and len(w.hash) >= 1 else []:
            if len(w.hash) < width:
                continue
            s = shingles(w.hash, width)
            p = np.flatnonzero(self.maybe[(s >> _U(42)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, s[p]), len(self.keys) - 1)
            ok = self.keys[k] == s[p]
            p, k = p[ok], k[ok]
            ok = p + width <= w.first[np.searchsorted(w.first, p, "right")]  # inside one document
            at.append(p[ok])
            which.append(k[ok])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def choose(self, counts: np.ndarray) -> None:
        """The prefix of a window is its rarest shingle; windows with a shingle that no document has cannot occur."""
        pairs = []
        for i, s in enumerate(self.each):
            k = np.searchsorted(self.keys, s)
            rare = np.lexsort((s, counts[k]))[0]
            if counts[k[rare]]:
                pairs.append((k[rare], i, rare))
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.keys, number = self.keys[np.unique(table[:, 0])], np.unique(table[:, 0], return_inverse=True)[1]
        self.from_key = np.searchsorted(number, np.arange(len(self.keys) + 1))
        self.window, self.place = table[:, 1], table[:, 2]
        self.each = []
        self._mark()

    def occurrences(self, w) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in a batch of documents."""
        at, key = self.find(w)
        n = self.from_key[key + 1] - self.from_key[key]
        entry = np.repeat(self.from_key[key] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at, window, place = np.repeat(at, n), self.window[entry], self.place[entry]
        doc = np.searchsorted(w.first, at, "right")
        start = at - place
        ok = (start >= w.first[doc - 1]) & (start + self.length[window] <= w.first[doc])
        start, window = start[ok], window[ok]
        same = np.ones(len(start), bool)
        for j in range(self.words.shape[1]):
            here = np.flatnonzero(same & (j < self.length[window]))
            same[here] = w.hash[start[here] + j] == self.words[window[here], j]
        return start[same], window[same]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and spans (first word
    and end of each run of hit words); ``keep_text`` keeps the column ``text``, and ``keep`` names columns that are kept in a struct ``kept``."""
    spark = docs.sparkSession
    found = materialize(windows(benchmark, size, item_col, item_text_col), "windows")
    blocks = max(1, -(-found.count() // BLOCK))
    numbered = found.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    own = [F.struct(*keep).alias("kept")] if keep else []
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *own).withColumn("hits", F.array().cast("array<long>")).withColumn("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "text", "hits", "items", *["kept"] * bool(keep))
    for i in range(blocks):
        rows = numbered.filter(F.col("block") == i).select("item", "words").collect()  # about BLOCK windows of the query set
        block = Block([r[0] for r in rows], [r[1] for r in rows])
        block.choose(_counts(docs.select(F.col(text_col)), block))
        shared = spark.sparkContext.broadcast(block)
        if i < blocks - 1:
            out = _mark(out, shared)
            if i % 4 == 3:
                out = materialize(out, "marked")
    mark, finish = _marker(shared), _finish(keep_text)
    schema = StructType.fromDDL("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>" + ", text string" * keep_text)
    return out.mapInArrow(lambda batches: finish(mark(batches)), StructType([*schema.fields, *out.schema.fields[4:]]))


def _counts(texts: DataFrame, block: Block) -> np.ndarray:
    """How often each shingle of the block occurs in all documents."""
    shared = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        total = np.zeros(len(shared.value.keys), np.int64)
        for b in slices(batches):
            total += np.bincount(shared.value.find(words(b.column(0), "alnum"))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    counts = np.zeros(len(block.keys), np.int64)
    for r in texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # the block's shingles
        counts[r.k] = r.n
    return counts


def _marker(shared):
    """Adds the block's occurrences to hits (first and end word, one after the other) and items."""

    def run(batches):
        block = shared.value
        for b in slices(batches):
            w = words(b.column(1), "alnum")
            start, window = block.occurrences(w)
            doc = np.searchsorted(w.first, start, "right") - 1
            order = np.lexsort((window, start))
            start, window, doc = start[order], window[order], doc[order]
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            hits, items = b.column(2).to_pylist(), b.column(3).to_pylist()
            for i in np.unique(doc):
                these = slice(cut[i], cut[i + 1])
                at = start[these] - w.first[i]
                hits[i] = hits[i] + np.stack([at, at + block.length[window[these]]], axis=1).ravel().tolist()
                numbers = np.unique(block.item[window[these]])
                items[i] = items[i] + [block.items[k] for k in numbers if k >= 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), *b.columns[4:]], names=["doc_id", "text", "hits", "items", *b.schema.names[4:]])

    return run


def _mark(docs: DataFrame, shared) -> DataFrame:
    return docs.mapInArrow(_marker(shared), docs.schema)


def _finish(keep_text: bool):
    def run(batches):
        for b in slices(batches):
            w = words(b.column(1), "alnum")
            n_words, n_hit, all_items, spans = np.diff(w.first), [], [], []
            for hits, items in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                runs: list[int] = []
                for s, e in sorted(zip(hits[::2], hits[1::2], strict=True)):
                    if runs and s <= runs[-1]:
                        runs[-1] = max(runs[-1], e)
                    else:
                        runs += [s, e]
                spans.append(runs)
                n_hit.append(sum(runs[1::2]) - sum(runs[::2]))
                all_items.append(sorted(set(items)))
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in all_items]
            arrays = [b.column(0), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in all_items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit]), pa.array(all_items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
            more, more_names = ([b.column(1)], ["text"]) if keep_text else ([], [])
            yield pa.RecordBatch.from_arrays([*arrays, *more, *b.columns[4:]], names=[*names, *more_names, *b.schema.names[4:]])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table ``docs`` without a hit, with their columns, which go along with the text."""
    others = tuple(c for c in docs.columns if c != text_col)
    found = decontaminate(docs.withColumn("__winnow_id", F.lit(0)), benchmark, id_col="__winnow_id", text_col=text_col, keep_text=True, keep=others)
    return found.filter(~F.col("contaminated")).select(*(F.col("text").alias(c) if c == text_col else F.col("kept").getField(c).alias(c) for c in docs.columns))
