"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those are kept that begin at a content-selected place: in every ``LENGTH`` words, the word
8-gram with the smallest hash. A passage of that many words that occurs twice has the same place chosen in both. Suffixes
whose 8-gram occurs once are let go. The others carry the words after and before their 8-gram, as far as the windows reach
that chose them, and are sorted by 8-gram, the words after it, and the words before it from right to left. Each is compared
with both neighbours: the words they have in common on the right, and from there on the left, are a match, which counts if
it is ``LENGTH`` words long.

The neighbour with the longest match on the right need not have the longest one on the left. So a suffix whose windows its
neighbours leave open has each of them looked up among the windows of all suffixes with its 8-gram, equal ones taken once.
The suffixes of a very frequent 8-gram are dealt to several groups, each of which is sorted by itself; what that parts, the
lookup finds as well.

Documents with the same words are one text in all this. Defined results: null and empty texts, and texts of fewer than
``LENGTH`` words, have no repeated passage; repeated rows repeat each other; an empty table gives no rows; other columns
are ignored. A passage that occurs twice within one text counts as repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, join_groups, materialize
from .wordhash import lists, long, mix, shingles, slices, stream, words

LENGTH, GRAM = 50, 8
#: Suffixes of one 8-gram that are sorted in one group, about.
GROUP = 4096
_U = np.uint64
#: Part of a key that tells its place, and windows whose places are chosen at once.
_PLACE = _U((1 << 20) - 1)
_AT_ONCE = 1 << 19


def chosen(w: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words, the word where its smallest 8-gram begins (by the 44 highest bits of their
    hashes; the first of equal ones). The minimum of a window is that of an end of one block and a beginning of the next."""
    grams, width, n = shingles(w, GRAM), length - GRAM + 1, len(w) - length + 1
    out = np.empty(n, np.int64)
    for lo in range(0, n, _AT_ONCE):
        m = min(n - lo, _AT_ONCE)
        g = grams[lo : lo + m + width - 1]
        keys = np.full(-(-len(g) // width) * width, ~_U(0))
        keys[: len(g)] = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        blocks = keys.reshape(-1, width)
        begin = np.minimum.accumulate(blocks, axis=1).ravel()
        end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        out[lo : lo + m] = (np.minimum(end[:m], begin[width - 1 : width - 1 + m]) & _PLACE).astype(np.int64) + lo
    return out


def window_hashes(w: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    step = stream(71, length) | _U(1)
    total = np.zeros(len(starts), np.uint64)
    for j in range(length):
        total += w[starts + j] * step[j]
    return mix(total)


def _describe(batches):
    for b in slices(batches):
        w = words(b.column(2), "exact")
        n, at = np.diff(w.first), np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
        sums = np.zeros((2, b.num_rows), np.uint64)
        for i, seed in enumerate((3, 5)):
            if len(w.hash):
                sums[i, n > 0] = np.add.reduceat(w.hash * stream(seed, 1)[0] * mix(at.astype(np.uint64) + _U(seed)), w.first[:-1][n > 0])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), *(pa.array(long(s)) for s in sums), b.column(2)], names=["row", "doc", "n", "d1", "d2", "text"])


def _suffixes(length: int):
    """gram, row, place of the gram, first and last window that chose it."""

    def run(batches):
        for b in slices(batches):
            w = words(b.column(1), "exact")
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, row in enumerate(b.column(0).to_pylist()):
                h = w.of(i)
                if len(h) < length:
                    continue
                at = chosen(h, length)
                lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                a = at[lo]
                for c, x in zip(cols, (long(shingles(h, GRAM)[a]), np.full(len(a), row), a, lo, np.r_[lo[1:], len(at)] - 1), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols], names=["gram", "row", "at", "lo", "hi"])

    return run


def _cut(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of 8 bytes a word, the highest first, so that they sort as words do."""
    at = np.r_[0, np.cumsum(size)]
    places = np.repeat(first - at[:-1], size) + np.arange(at[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(8 * at), pa.py_buffer(flat[places].astype(">u8"))]).cast(pa.binary())


def _contexts(length: int):
    """Over texts with their suffixes: the words after the gram as far as the last window reaches, and those before it, the nearest first."""

    def run(batches):
        for b in slices(batches):
            w = words(b.column(1), "exact")
            each = b.column(2).flatten()
            gram, at, lo, hi, groups = (each.field(i).to_numpy() for i in range(5))
            n = np.diff(b.column(2).offsets.to_numpy())
            begin = np.repeat(w.first[:-1], n)
            after = _cut(w.hash, begin + at + GRAM, hi + length - at - GRAM)
            before = _cut(w.hash[::-1], len(w.hash) - begin - at, at - lo)
            yield pa.RecordBatch.from_arrays([pa.array(gram), after, before, pa.array(np.repeat(b.column(0).to_numpy(), n)), *map(pa.array, (at, lo, hi, groups))], names=["gram", "after", "before", "row", "at", "lo", "hi", "groups"])

    return run


def _common(values: pa.Array, same: np.ndarray) -> np.ndarray:
    """How many words each value has in common with the next one, where ``same``."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1] // 8
    flat = np.frombuffer(values.buffers()[2], ">u8") if values.buffers()[2] is not None else np.empty(0, ">u8")
    size = np.diff(at)
    most, out = np.minimum(size[:-1], size[1:]), np.zeros(len(same), np.int64)
    live, j = np.flatnonzero(same & (most > 0)), 0
    while len(live):
        live = live[flat[at[live] + j] == flat[at[live + 1] + j]]
        j += 1
        out[live] = j
        live = live[most[live] > j]
    return out


def _neighbours(length: int):
    """Over sorted suffixes: the match with the neighbour above and the one below (first and end word; equal, if there is
    none), whether they leave no window of the suffix open, and whether it differs from the one above."""

    def run(batches):
        rest, top = None, None

        def out(b: pa.RecordBatch, right: np.ndarray, left: np.ndarray, equal: np.ndarray, same: np.ndarray, rows: slice) -> pa.RecordBatch:
            """``right``, ``left``, ``equal``: of each row and the next; those of a row and the one above come before."""
            at, lo, hi = (b.column(i).to_numpy()[rows] for i in (4, 5, 6))
            cols = []
            for k in (slice(rows.start, rows.stop), slice(rows.start + 1, rows.stop + 1)):
                r, n = np.where(same[k], right[k] + GRAM, 0), left[k]
                long_enough = r + n >= length
                cols += [np.where(long_enough, at - n, at), np.where(long_enough, at + r, at)]
            f1, e1, f2, e2 = cols
            # Two matches leave nothing open if one is all, or if they share a window's words but one.
            low, high = np.minimum(f1, f2), np.maximum(e1, e2)
            joined = np.minimum(e1, e2) - np.maximum(f1, f2) >= length - 1
            full = ((f1 == lo) & (e1 == hi + length)) | ((f2 == lo) & (e2 == hi + length)) | (joined & (low == lo) & (high == hi + length))
            arrays = [b.column(0).slice(rows.start, rows.stop - rows.start), b.column(3).slice(rows.start, rows.stop - rows.start), *map(pa.array, (lo, hi, f1, e1, f2, e2, full, ~equal[rows]))]
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "row", "lo", "hi", "f1", "e1", "f2", "e2", "full", "lead"])

        def compared(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            gram = b.column(0).to_numpy()
            same = gram[1:] == gram[:-1]
            right, left = _common(b.column(1), same), _common(b.column(2), same)
            sizes = [np.diff(np.frombuffer(b.column(i).buffers()[1], np.int32)[b.column(i).offset : b.column(i).offset + b.num_rows + 1]) // 8 for i in (1, 2)]
            equal = same & (sizes[0][1:] == sizes[0][:-1]) & (sizes[1][1:] == sizes[1][:-1]) & (right == sizes[0][1:]) & (left == sizes[1][1:])
            return right, left, equal, same

        edge = lambda x: np.concatenate((np.zeros(1, x.dtype), x, np.zeros(1, x.dtype)))
        for b in batches:
            if not b.num_rows:
                continue
            # The row above the first one is kept for comparison, and the last row waits for the next batch.
            b = pa.concat_batches([x for x in (top, rest, b) if x is not None])
            skip = int(top is not None)
            if b.num_rows - skip > 1:
                yield out(b, *map(edge, compared(b)), slice(skip, b.num_rows - 1))
                top = pa.concat_batches([b.slice(b.num_rows - 2, 1)])
            rest = pa.concat_batches([b.slice(b.num_rows - 1)])
        if rest is not None:
            b = pa.concat_batches([x for x in (top, rest) if x is not None])
            yield out(b, *map(edge, compared(b)), slice(b.num_rows - 1, b.num_rows))

    return run


def _windows(length: int):
    def run(batches):
        for b in slices(batches, 256):
            w = words(b.column(1), "exact")
            out: list[list[np.ndarray]] = [[], [], []]
            for i, (row, lo, hi) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                starts = np.unique(np.concatenate([np.arange(a, z + 1) for a, z in zip(lo, hi, strict=True)]))
                for c, x in zip(out, (long(window_hashes(w.of(i), starts, length)), np.full(len(starts), row), starts), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=["window", "row", "start"])

    return run


def _merge(batches):
    """Spans of each row from its repeated stretches (first and end word)."""
    for b in batches:
        rows, firsts, ends = [], [], []
        for row, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
            order = np.argsort(lo, kind="stable")
            lo, hi = np.array(lo)[order], np.maximum.accumulate(np.array(hi)[order])
            new = np.r_[True, lo[1:] > hi[:-1]]
            rows += [row] * int(new.sum())
            firsts += lo[new].tolist()
            ends += hi[np.r_[new[1:], True]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, firsts, ends)], names=["row", "first_word", "end_word"])


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each longest stretch of words in a row of the table ``docs`` that is made of repeated passages of
    ``length`` words: doc_id, first_word, end_word, n_words."""
    # Numbered once, as rows are written: another scan of ``docs`` may number them otherwise.
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    described = materialize(source.mapInArrow(_describe, "row long, doc long, n long, d1 long, d2 long, text string"), "described")
    base = materialize(described.drop("text"), "passages")
    key = ["n", "d1", "d2"]
    total = base.count()
    classes = materialize(base.filter(F.col("n") >= length).groupBy(*key).agg(F.min("row").alias("rep"), F.count("*").alias("size")), "texts")
    copies = join_groups(base, classes.filter("size > 1"), key, "size", total).select("doc", F.lit(0).cast("long").alias("first_word"), F.col("n").alias("end_word"))

    text = materialize(described.select("row", "text").join(classes.select(F.col("rep").alias("row")), "row", "left_semi"), "texts")
    discard(described)
    suffixes = materialize(text.mapInArrow(_suffixes(length), "gram long, row long, at long, lo long, hi long"), "suffixes")
    counts = materialize(suffixes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "grams")
    kept = suffixes.join(counts.hint("merge"), "gram").withColumn("groups", F.ceil(F.col("n") / GROUP).cast("int"))
    of_text = kept.groupBy("row").agg(F.collect_list(F.struct("gram", "at", "lo", "hi", "groups")).alias("suffixes"))  # of one text
    carried = text.join(of_text.hint("merge"), "row").select("row", "text", F.col("suffixes").cast("array<struct<gram:bigint,at:bigint,lo:bigint,hi:bigint,groups:bigint>>").alias("suffixes"))
    carried = carried.mapInArrow(_contexts(length), "gram long, after binary, before binary, row long, at long, lo long, hi long, groups long")
    group = F.pmod(F.xxhash64("row", "at"), F.col("groups"))
    ordered = carried.repartition(F.col("gram"), group).drop("groups").sortWithinPartitions("gram", "after", "before")
    judged = ordered.mapInArrow(_neighbours(length), "gram long, row long, lo long, hi long, f1 long, e1 long, f2 long, e2 long, full boolean, lead boolean")
    judged = materialize(judged, "neighbours")
    discard(suffixes)
    matches = judged.select("row", F.inline(F.array(F.struct(F.col("f1").alias("first"), F.col("e1").alias("end")), F.struct(F.col("f2").alias("first"), F.col("e2").alias("end"))))).filter("first < end")

    # Windows that neighbours leave open, among those of all that have the 8-gram; of equal suffixes one stands for all.
    partial = judged.filter("not full").select("gram", "row", "lo", "hi")
    partners = judged.filter("full and lead").join(partial.select("gram").distinct().hint("merge"), "gram", "left_semi").select("gram", "row", "lo", "hi")
    places = partial.union(partners).groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # of one text
    around = text.join(places.hint("merge"), "row").select("row", "text", "lo", "hi").mapInArrow(_windows(length), "window long, row long, start long")
    around = materialize(around, "windows")
    repeated = around.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").select("window")
    extended = around.join(repeated.hint("merge"), "window", "left_semi").select("row", F.col("start").alias("first"), (F.col("start") + length).alias("end"))
    stretches = matches.union(extended).groupBy("row").agg(F.collect_list("first").alias("lo"), F.collect_list("end").alias("hi"))  # of one text
    spans = stretches.mapInArrow(_merge, "row long, first_word long, end_word long")
    alone = classes.filter("size = 1").select(F.col("rep").alias("row")).join(base.select("row", "doc").hint("merge"), "row")
    found = spans.join(alone.hint("merge"), "row").select("doc", "first_word", "end_word").unionByName(copies)
    return found.select(F.col("doc").alias(id_col), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))
