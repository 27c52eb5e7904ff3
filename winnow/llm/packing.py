"""Best-fit packing by linear grouping.

Documents are tokenized where they lie; all that the packing needs from the corpus is how many pieces there are of each
length, at most ``capacity`` numbers. The plan is made from those: a full piece is a sequence; other lengths above
``small`` (a quarter of ``capacity``) are sorted and cut into few groups of equal cardinality, each rounded up to its largest length; how often each
configuration of the group sizes is used is a linear program, solved exactly by column generation (the next configuration
is always the knapsack that the current prices value most), and rounded down; actual lengths take the places of the
rounded ones; what rounding left over, and last the small pieces, go by best fit into what is left. The plan says, for
each length, which ranks go to which sequences. The task that cuts a piece numbers it among the pieces of its length in
that task; sums of those counts over tasks make ranks of them. Pieces and sums meet by task, so no length is hot and
nothing but counts by length goes to the driver.

Defined results: a null text counts as empty and gives a piece of one token (the end token); repeated rows are packed
each; an empty table gives no rows; other columns are ignored. A document of more than ``capacity`` tokens is cut into
full pieces, its first piece being the shorter remainder.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize
from .tokens import encoder, tokenizer_path
from .wordhash import slices

#: Sizes that the linear program knows; steps it takes at most, as it can stop at any step with a plan that is whole; and the
#: part by which its result may be over the least possible.
GROUPS, STEPS, SLACK = 192, 4000, 1e-3


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece of each document, with the task that
    cut it and its number among the task's pieces of that length."""
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    kinds |= {"task": pa.int32(), "number": pa.int64()}

    def cut(batches):
        enc, end, task = encoder(tokenizer), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for b in slices(batches):
            out = {k: [] for k in kinds}
            for doc, own in zip(b.column(0).to_pylist(), enc.encode_batch(b.column(1)), strict=True):
                ids = own + end
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = at + (n % capacity or capacity) if k == 0 else at + capacity
                    part = ids[4 * at : 4 * to]
                    for name, v in (("doc_id", doc), ("piece", k), ("start", at), ("length", to - at), ("ids_crc32", zlib.crc32(part)), ("task", task), ("number", seen[to - at])):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                    seen[to - at] += 1
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", task int, number long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class _Open:
    """Runs of equal sequences by room left; best fit takes the least room that suffices."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((first, n))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        at = bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        first, n = self.runs[room].pop()
        if n > most:
            self.runs[room].append((first + most, n - most))
            n = most
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(at)
        return room, first, n


def groups_of(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: (length, count) lists of equal cardinality, longest first; a length's pieces may lie in two groups."""
    total = sum(counts.values())
    each = max(1, -(-total // n_groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            if not room:
                out.append([])
                room = each
            m = min(n, room)
            out[-1].append((size, m))
            n, room = n - m, room - m
    return out


def _worth(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest price that fits, and its price: an unbounded knapsack. ``sizes`` ascend."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(int(sizes[0]), capacity + 1):
        each = best[room - sizes[: fitting[room]]] + prices[: fitting[room]]
        k = int(each.argmax())
        best[room], taken[room] = (each[k], k) if each[k] > best[room - 1] else (best[room - 1], -1)
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        out[taken[room]] += 1
        room -= int(sizes[taken[room]])
    return float(best[capacity]), out


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each size) and how often each is used, so that all demand is met with the fewest
    sequences if parts of a sequence were allowed. The revised simplex method; a configuration is made when prices ask for
    it, at first by prices between the current ones and the best known bound's, which changes course less often."""
    order = np.argsort(sizes, kind="stable")
    size, wanted = np.array(sizes)[order], np.array(demand, float)[order]
    columns = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    # Demands that differ a little keep the method from turning in circles.
    used = inverse @ (wanted * (1 + 1e-9 * np.arange(1, len(size) + 1)))
    steady, bound = size / capacity, 0.0
    for _ in range(steps):
        prices = inverse.sum(axis=0)
        for own in (0.2, 1.0):
            asked = own * prices + (1 - own) * steady
            worth, new = _worth(size, asked, capacity)
            if (asked >= 0).all() and wanted @ asked > bound * worth:  # prices at which no configuration is worth more than 1
                steady, bound = asked / worth, wanted @ asked / worth
            if prices @ new > 1 + 1e-6:
                break
        if prices @ new <= 1 + 1e-6 or used.sum() <= bound * (1 + SLACK):
            break
        change = inverse @ new
        rising = np.flatnonzero(change > 1e-9)
        out = rising[np.argmin(used[rising] / change[rising])]
        amount = used[out] / change[out]
        used = np.maximum(used - amount * change, 0)
        used[out] = amount
        columns[:, out] = new
        pivot = inverse[out] / change[out]
        inverse -= np.outer(change, pivot)
        inverse[out] = pivot
    back = np.argsort(order, kind="stable")
    return [(columns[back, j], float(used[j])) for j in range(len(size)) if used[j] > 0]


def plan(counts: dict[int, int], capacity: int, small: int | None = None, n_groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): that many pieces from that rank on go to as many successive
    sequences. Its size depends on ``capacity`` and ``n_groups``, not on the number of pieces."""
    small = capacity // 4 if small is None else small
    counts = {k: v for k, v in counts.items() if v}
    left, used = Counter(counts), dict.fromkeys(counts, 0)
    out: list[tuple[int, int, int, int, int]] = []
    opened, sequence = _Open(), 0

    def put(size: int, n: int, first: int, offset: int) -> None:
        out.append((size, used[size], n, first, offset))
        used[size] += n
        left[size] -= n

    if left[capacity]:
        sequence = left[capacity]
        put(capacity, sequence, 0, 0)
    groups = groups_of({k: v for k, v in left.items() if v and k > small}, n_groups)
    sizes, demand = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    for chosen, share in configurations(sizes, demand, capacity) if groups else ():
        need = {g: int(chosen[g]) for g in np.flatnonzero(chosen).tolist()}
        there = {g: sum(n for _, n in groups[g]) for g in need}
        times = min(int(share + 1e-6), *(there[g] // k for g, k in need.items()))
        while times:  # actual lengths instead of rounded ones: runs in which no place's length changes
            m = min(times, *(groups[g][-1][1] // k for g, k in need.items())) or 1
            taken, offset = [], 0
            for g in (g for g, k in need.items() for _ in range(k)):
                size, n = groups[g].pop()
                if n > m:
                    groups[g].append((size, n - m))
                taken.append(size)
            for size in sorted(taken, reverse=True):
                put(size, m, sequence, offset)
                offset += size
            opened.add(capacity - offset, sequence, m)
            sequence, times = sequence + m, times - m
    for size in sorted(counts, reverse=True):  # what rounding left over, then the small ones
        n = left[size]
        while n:
            found = opened.take(size, n)
            if not found:
                fit = capacity // size
                whole, over = divmod(n, fit)
                for j in range(fit if whole else 0):
                    put(size, whole, sequence, j * size)
                opened.add(capacity - fit * size, sequence, whole)
                sequence += whole
                for j in range(over):
                    put(size, 1, sequence, j * size)
                if over:
                    opened.add(capacity - over * size, sequence, 1)
                    sequence += 1
                break
            room, at, m = found
            put(size, m, at, capacity - room)
            opened.add(room - size, at, m)
            n -= m
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each piece's columns with sequence_id and offset; ``with_ids`` adds the token ids themselves."""
    # Tasks and numbers are written with the pieces, so all that follows reads the same ones.
    table = materialize(pieces(docs, tokenizer or tokenizer_path(), capacity, end_id, id_col, text_col, with_ids), "pieces")
    by_task = materialize(table.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    starts = by_task.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("task").agg(F.collect_list(F.struct("length", "before")).alias("starts"))  # of one task
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    kept = [c for c in table.columns if c not in ("task", "number")]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name not in ("task", "number")]
    both = starts.select(*none, "task", F.lit(-1).cast("long").alias("number"), "starts").unionByName(table.withColumn("starts", F.lit(None).cast(starts.schema["starts"].dataType)))

    def place(batches):
        """Over rows sorted by (task, number): a task's starts come first."""
        runs, own = shared.value, np.zeros(capacity + 1, np.int64)
        keys = runs[:, 0] * (1 << 44) + runs[:, 1]
        for b in batches:
            heads = np.flatnonzero(b.column("number").to_numpy() < 0).tolist()
            for lo, hi in zip([0, *heads], [*heads, b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                if part.num_rows and part.column("number")[0].as_py() < 0:
                    own = np.zeros(capacity + 1, np.int64)
                    for x in part.column("starts")[0].as_py():
                        own[x["length"]] = x["before"]
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                length = part.column("length").to_numpy()
                rank = part.column("number").to_numpy() + own[length]
                at = np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1
                assert (runs[at, 0] == length).all()
                arrays = [part.column(k) for k in kept]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in kept)
    return both.repartition(F.col("task")).sortWithinPartitions("task", "number").mapInArrow(place, f"{schema}, sequence_id long, offset long")
