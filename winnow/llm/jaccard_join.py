"""Exact Jaccard self-join of word-shingle sets by PartEnum signatures.

Two sets of n and m elements with a similarity of at least t differ in at most (n + m)(1 - t) / (1 + t) elements, and the
larger has at most 1 / t times the elements of the smaller. So sets are dealt to bands of sizes, linked sets lie in the same
or in successive bands, and each set joins its own band and, if it can have partners there, the next one. In a band, the
domain of all shingles is partitioned twice: into n1 parts, and each part into three. Differences are too few to spoil
every part: in one at least, two of its three parts are equal. Each choice of two of three, with a set's elements there, is a
signature, and linked sets share one.

Linked sets even share more than one: all but as many as their differences spoil. So, of its signatures, a set needs only a
prefix in an order that holds for all sets; the first ones are those with most elements, which the fewest other sets share.
A signature that very many sets have in their prefixes, as from a passage that they all quote, is put last in the order
after the fact: the sets that have it take the next ones in its place. Two sets that share no other signature than such ones
both have them, so only these sets need be dealt again.

The join needs no list of all pairs: equal sets are one class; rows of a signature form a bucket; each class is first
held against the bucket leader it shares most signatures with, which joins most groups. Classes that still are in different
components and share a bucket are compared. All pairs meet by parity sketches first (a lower bound on the number of
differing elements), and those that pass by their sets. So no link between different components goes unchecked.

``GROWING`` says how to do that where many rows of large groups are not linked to their leaders: first, each row in a block
of its bucket offers only its nearest by sketch, at a cost that is linear in the bucket; then components are merged, and all
that is left of every bucket is compared. Each row also carries its smallest signatures, so that a pair that shares one of
them is offered by the bucket of the first of them alone and not by every bucket that both are in.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, free_shuffles, join_groups, materialize, parts
from .wordhash import lists, long, mix, shingle_sets, slices, words

_U = np.uint64
#: Rows of a bucket that are compared in one task; larger buckets are compared block against block.
BLOCK = 1024
#: Rows of a bucket from which on its signature is put last in the order, and how many times that is done. Up to there, all
#: against all costs less (n * n / 2 sketches of about 0.1 us) than all signatures of the sets (n times about 1,000 of 3 us).
CROWD, ROUNDS = 1 << 16, 3
#: Pairs that a task holds to give each once.
PAIRS = 1 << 20
#: Pairs of one set that are verified in one task.
STAR = 512
#: Sets with more than STAR pairs, up to which a table of them is broadcast.
STARS = 100_000
#: (1 / share of the buckets, whether only the nearest of each row's block is offered) of each pass; the last one leaves nothing out.
PLAIN = ((1, False),)
GROWING = ((4, True), (1, False))
#: Signatures that a row carries if there are several passes.
CARRIED = 4
_TAGS = 128


class Scheme:
    """Bands and PartEnum parameters for sets whose similarity is at least num / den."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den
        ratio = max(2, -(-den // num))
        self.top = [ratio - 1]  # largest size of each band
        while self.top[-1] < 1 << 40 and len(self.top) < _TAGS - 1:
            self.top.append(ratio * (self.top[-1] + 1) - 1)
        self.tops = np.array(self.top)

    def differ(self, n: int, m: int) -> int:
        """Most elements in which linked sets of n and m elements differ."""
        return (n + m) * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.tops, n))

    def tags(self, n: int) -> list[tuple[int, int]]:
        """The bands that a set of n elements joins, and in how many elements it may differ from larger sets there."""
        own, most = self.band(n), n * self.den // self.num
        both = [(own, min(most, self.top[own])), (own + 1, most)]
        return [(tag, self.differ(n, m)) for tag, m in both[: 1 + (most > self.top[own])]]

    def parts(self, tag: int) -> int:
        """n1: more than half of the differences that are possible in the band; a few more for small sets, so that their elements lie apart."""
        return max(24, self.differ(self.top[tag], self.top[tag]) * 11 // 20 + 2)

    def prefix(self, tag: int, differ: int) -> int:
        """How many signatures a set needs in its prefix. A difference spoils two of a part's three signatures, and a second one in the same part the third."""
        n1 = self.parts(tag)
        return 2 * min(differ, n1) + min(max(differ - n1, 0), n1) + 1

    def bits(self, tag: int) -> int:
        """64-bit words of a parity sketch: a bit an element, and no less than what the other columns of a row take."""
        return max(8, -(-self.top[tag] // 64))

    def signatures(self, flat: np.ndarray, first: np.ndarray, whole: bool = False) -> tuple[np.ndarray, ...]:
        """Of sorted sets of hashes, one after the other: signatures and the number of the set that each is of. A signature's lowest
        bits tell its band. Signatures are ordered by their numbers of elements, most first, then by hash. ``whole``: not the
        prefix but all signatures, and how many the prefix has."""
        n = np.diff(first)
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat), out=sums[1:])
        joins: dict[int, list[tuple[int, int]]] = {}
        shapes = {size: self.tags(size) for size in np.unique(n).tolist() if size}
        for i, size in enumerate(n.tolist()):
            for tag, differ in shapes.get(size, ()):
                if differ:  # else only equal sets can be linked, and those are one set here
                    joins.setdefault(tag, []).append((i, self.prefix(tag, differ)))
        sigs, owners, lengths = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for tag, sets in joins.items():
            n1 = self.parts(tag)
            m = 3 * n1
            where = mix(np.arange(m, dtype=np.uint64) + (_U(tag) << _U(40)) + _U(1))
            for some in np.array_split(np.array(sets), -(-len(sets) * m // (1 << 20))):
                i, wanted = some[:, 0], some[:, 1]
                size = n[i]
                before = np.cumsum(size) - size
                at = np.arange(size.sum()) - np.repeat(before - first[i], size)  # places of these sets' elements in flat
                part = ((flat[at] >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
                key = np.repeat(np.arange(len(i)) * m, size) + part
                filled = np.bincount(key, minlength=len(i) * m)
                ends = np.cumsum(filled).reshape(len(i), m)
                base = (first[i] - before)[:, None]
                total = sums[ends + base] - sums[ends - filled.reshape(len(i), m) + base]
                filled = filled.reshape(len(i), n1, 3)
                value = mix(total + where).reshape(len(i), n1, 3)
                # All pairs of a part's three second-level parts; of each pair, one more than the other is left out.
                value = value + np.roll(value, -1, axis=2)
                count = np.minimum(filled + np.roll(filled, -1, axis=2), 255).astype(np.uint64)
                sig = (mix(value.reshape(len(i), m) + where) >> _U(8)) | ((_U(255) - count.reshape(len(i), m)) << _U(56))
                sig.sort(axis=1)
                taken = np.arange(m) < (m if whole else wanted[:, None])
                taken = np.broadcast_to(taken, sig.shape)
                sigs.append((sig[taken] & ~_U(_TAGS - 1)) | _U(tag))
                owners.append(np.repeat(i, taken.sum(axis=1)))
                lengths.append(np.repeat(wanted, taken.sum(axis=1)))
        return (np.concatenate(sigs), np.concatenate(owners), *([np.concatenate(lengths)] * whole))

    def sketch(self, s: np.ndarray, tag: int) -> np.ndarray:
        """One bit for each part of the domain: whether the set has an odd number of elements there."""
        n_bits = 64 * self.bits(tag)
        odd = np.bincount((mix(s ^ _U(0x5851F42D4C957F2D)) % _U(n_bits)).astype(np.int64), minlength=n_bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _batch(schema: str, arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=schema.split())


def _describe(k: int):
    def run(batches):
        for b in slices(batches):
            flat, first = shingle_sets(words(b.column(3), "space"), k)
            n = np.diff(first)
            some = first[:-1][n > 0]
            sums = np.zeros((2, b.num_rows), np.uint64)
            for i, seed in enumerate((0, 0xA0761D6478BD642F)):
                if len(some):
                    sums[i, n > 0] = np.add.reduceat(mix(flat ^ _U(seed)), some)
            yield _batch("row doc h n d1 d2 text", [*b.columns[:3], n, long(sums[0]), long(sums[1]), b.column(3)])

    return run


def _sign(k: int, scheme: Scheme):
    def run(batches):
        for b in slices(batches):
            sigs, owners = scheme.signatures(*shingle_sets(words(b.column(1), "space"), k))
            yield _batch("sig row", [long(sigs), b.column(0).to_numpy()[owners]])

    return run


def _every(k: int, scheme: Scheme):
    """All signatures of each row, and how many its prefix has."""

    def run(batches):
        for b in slices(batches, 64):
            sigs, owners, wanted = scheme.signatures(*shingle_sets(words(b.column(1), "space"), k), whole=True)
            yield _batch("sig row wanted", [long(sigs), b.column(0).to_numpy()[owners], wanted])

    return run


def _lead(batches):
    """Over rows sorted by sig (by that alone, so that Spark sorts by radix): each row of a bucket but its leader, with its
    leader, which is the smallest row among the bucket's rows in the batch where it begins."""
    last, leader = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        sig, row = b.column(0).to_numpy(), b.column(1).to_numpy()
        at = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        least = np.minimum.reduceat(row, at)
        if sig[0] == last:
            least[0] = leader
        last, leader = sig[-1], least[-1]
        leaders = np.repeat(least, np.diff(np.r_[at, len(sig)]))
        keep = leaders != row
        yield _batch("sig leader row", [sig[keep], leaders[keep], row[keep]])


def _verify(k: int, num: int, den: int):
    """Over rows sorted by (u, salt, kind): links of the first set of a group with each of the others."""

    def run(batches):
        group, first = None, None
        for b in slices(batches, 256):
            us, vs, links = [], [], []
            flat, at = shingle_sets(words(b.column(4), "space"), k)
            sets = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            for u, salt, kind, v, s in zip(*(b.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if kind == 0:
                    group, first = (u, salt), s
                    continue
                assert group == (u, salt)
                both = len(np.intersect1d(first, s, assume_unique=True))
                us.append(u)
                vs.append(v)
                links.append(den * both >= num * (len(first) + len(s) - both))
            yield _batch("u v link", [pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(links, pa.bool_())])

    return run


def _sketches(k: int, scheme: Scheme, carried: int):
    """Sketches for each band that a row joins, each followed by the smallest ``carried`` signatures there; where a row has
    fewer, by values of its own."""

    def run(batches):
        for b in slices(batches):
            row, tag, n, out = [], [], [], []
            flat, at = shingle_sets(words(b.column(1), "space"), k)
            sigs, owners = scheme.signatures(flat, at) if carried else (flat[:0], at[:0])
            order = np.argsort(owners, kind="stable")
            sigs, cut = sigs[order], np.searchsorted(owners[order], np.arange(b.num_rows + 1))
            for i, r in enumerate(b.column(0).to_pylist()):
                s, mine = flat[at[i] : at[i + 1]], sigs[cut[i] : cut[i + 1]]
                for t, _ in scheme.tags(len(s)):
                    own = np.sort(long(mine[(mine & _U(_TAGS - 1)) == _U(t)]))[:carried]
                    own = np.r_[own, np.full(carried - len(own), (r << 7) | (_TAGS - 1))]
                    row.append(r)
                    tag.append(t)
                    n.append(len(s))
                    out.append(np.r_[long(scheme.sketch(s, t)), own])
            yield _batch("row tag n sketch", [pa.array(row, pa.int64()), pa.array(tag, pa.int64()), pa.array(n, pa.int64()), lists(out, pa.int64())])

    return run


def _near(num: int, den: int, nearest: bool, carried: int, once: bool = True):
    """Over rows sorted by (sig, x, y): pairs of a group in different components that sketches and sizes do not tell apart;
    if ``nearest``, for each row only the one with the most equal sketch; else, if ``once``, pairs that share a carried
    signature smaller than the bucket's are left to the bucket of the smallest one."""

    def compare(rows: pa.RecordBatch) -> np.ndarray:
        sig, x, y, block, row, comp, n = (rows.column(i).to_numpy() for i in range(7))
        at, data = rows.column(7).offsets.to_numpy(), rows.column(7).values.to_numpy().view(np.uint64)
        us, vs = [], []
        least, partner = np.full(len(sig), np.iinfo(np.int64).max), np.full(len(sig), -1)
        d, alive = 1, np.arange(len(sig) - 1)
        while len(alive):
            i, j = alive, alive + d
            same = (sig[i] == sig[j]) & (x[i] == x[j]) & (y[i] == y[j])
            i, j = i[same], j[same]
            alive = i[i + d + 1 < len(sig)]
            keep = (comp[i] != comp[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            keep &= den * small >= num * large
            i, j = i[keep], j[keep]
            size = at[i + 1] - at[i]
            for width in np.unique(size):
                these = np.flatnonzero(size == width)
                for part in np.array_split(these, -(-len(these) * int(width) // (1 << 21)) or 1):
                    p, q = i[part], j[part]
                    span = np.arange(width - carried)
                    odd = np.bitwise_count(data[at[p][:, None] + span] ^ data[at[q][:, None] + span]).sum(axis=1, dtype=np.int64)
                    ok = odd * (den + num) <= (n[p] + n[q]) * (den - num)
                    if nearest:
                        for own, other in ((p, q), (q, p)):  # either has no row twice
                            better = ok & (odd < least[own])
                            least[own[better]], partner[own[better]] = odd[better], other[better]
                        continue
                    p, q, last = p[ok], q[ok], np.arange(width - carried, width)
                    a, b = (data[at[x][:, None] + last].view(np.int64) for x in (p, q))
                    first = ~((a[:, :, None] == b[:, None, :]).any(axis=2) & (a < sig[p][:, None])).any(axis=1) if once else slice(None)
                    p, q = p[first], q[first]
                    us.append(np.minimum(row[p], row[q]))
                    vs.append(np.maximum(row[p], row[q]))
            d += 1
        if nearest:
            p = np.flatnonzero(partner >= 0)
            us.append(np.minimum(row[p], row[partner[p]]))
            vs.append(np.maximum(row[p], row[partner[p]]))
        return np.stack([np.concatenate(us), np.concatenate(vs)], axis=1) if us else np.empty((0, 2), np.int64)

    def run(batches):
        """A pair that several buckets of a task offer is given once, as far as memory goes."""
        rest, pairs, n = None, [], 0

        def ready() -> pa.RecordBatch:
            once = np.unique(np.concatenate([*pairs, np.empty((0, 2), np.int64)]), axis=0)
            return _batch("u v", [np.ascontiguousarray(once[:, 0]), np.ascontiguousarray(once[:, 1])])

        for b in batches:
            if not b.num_rows:
                continue
            b = pa.concat_batches([rest, b]) if rest is not None else b
            keys = np.stack([b.column(i).to_numpy() for i in range(3)])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                pairs.append(compare(pa.concat_batches([b.slice(0, cut)])))
                n += len(pairs[-1])
            rest = b.slice(cut)
            if n > PAIRS:
                yield ready()
                pairs, n = [], 0
        if rest is not None:
            pairs.append(compare(pa.concat_batches([rest])))
            yield ready()

    return run


def _apart(num: int, den: int, carried: int):
    """Over a pair's sizes and sketches: whether they leave it possible that the sets are linked."""

    def test(n, m, a, b):
        small, large = F.least(n, m), F.greatest(n, m)
        width = F.size(a) - carried
        odd = F.aggregate(F.zip_with(F.slice(a, F.lit(1), width), F.slice(b, F.lit(1), width), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        return (den * small >= num * large) & (odd * (den + num) <= (n + m) * (den - num))

    return test


def _grouped(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, passes: tuple) -> DataFrame:
    """For each row of ``docs``: doc, h (a hash of its text), n, component (a number), component_id, n_texts."""
    scheme, spark = Scheme(num, den), docs.sparkSession
    carried = CARRIED
    free_shuffles(spark)
    # Numbered once, as the rows are written: another scan of ``docs`` may number them otherwise.
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    described = materialize(source.mapInArrow(_describe(k), "row long, doc long, h long, n long, d1 long, d2 long, text string"), "described")
    base = materialize(described.drop("text"), "sets")
    total = base.count()
    key = ["n", "d1", "d2"]
    classes = materialize(base.filter("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc").alias("doc"), F.count("*").alias("size")), "classes")
    if not total:
        discard(described)
        return base.select("doc", "h", "n", F.col("row").alias("component"), F.col("doc").alias("component_id"), F.lit(1).cast("long").alias("n_texts"))

    # One text of each class, bucketed by row: later joins read it in place.
    texts = f"winnow_texts_{uuid.uuid4().hex}"
    buckets = parts(spark)
    picked = described.select("row", "text").join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    picked.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row").mode("overwrite").format("parquet").saveAsTable(texts)
    try:
        discard(described)
        free_shuffles(spark)
        comp = _linked(spark.table(texts), k, scheme, passes, carried)
        known = classes.join(comp.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        known = materialize(known, "classes-known")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {texts}")
    free_shuffles(spark)
    ids = known.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("n_texts"))
    known = known.join(ids.hint("merge"), "component").select(*key, "size", "component", "component_id", "n_texts")
    joined = join_groups(base.filter("n > 0"), known, key, "size", total).select("doc", "h", "n", "component", "component_id", "n_texts")
    alone = base.filter("n = 0").select("doc", "h", "n", F.col("row").alias("component"), F.col("doc").alias("component_id"), F.lit(1).cast("long").alias("n_texts"))
    return joined.unionByName(alone)


def _uncrowded(text: DataFrame, rows: DataFrame, comp: DataFrame, k: int, scheme: Scheme) -> tuple[DataFrame, bool]:
    """Open buckets (sig, row, comp) with crowded signatures put last in the order, and whether there were any."""
    every = crowded = None
    for _ in range(ROUNDS):
        sizes = rows.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("sig")
        new = materialize(sizes if crowded is None else sizes.join(crowded.hint("merge"), "sig", "left_anti"), "crowded")
        if new.isEmpty():
            break
        again = materialize(rows.join(new.hint("merge"), "sig", "left_semi").select("row").distinct(), "again")
        fresh = again if every is None else again.join(every.select("row").distinct().hint("merge"), "row", "left_anti")
        fresh = materialize(text.join(fresh.hint("merge"), "row", "left_semi").mapInArrow(_every(k, scheme), "sig long, row long, wanted long"), "every")
        every, crowded = (fresh, new) if every is None else (every.union(fresh), crowded.union(new))
        last = every.join(again.hint("merge"), "row", "left_semi").join(crowded.withColumn("last", F.lit(True)).hint("merge"), "sig", "left")
        # Signatures are ordered as unsigned numbers; a row's, of one band.
        order = F.struct(F.coalesce("last", F.lit(False)).alias("last"), F.col("sig").bitwiseXOR(F.lit(-(1 << 63))).alias("key"), F.col("sig"))
        prefix = last.groupBy("row", F.col("sig").bitwiseAND(_TAGS - 1).alias("tag")).agg(F.max("wanted").cast("int").alias("wanted"), F.sort_array(F.collect_list(order)).alias("order"))
        dealt = prefix.select("row", F.explode(F.slice("order", F.lit(1), F.col("wanted"))).alias("x")).select(F.col("x.sig").alias("sig"), "row")
        known = comp.select(F.col("node").alias("row"), F.col("component"))
        dealt = dealt.join(known.hint("merge"), "row", "left").select("sig", "row", F.coalesce("component", "row").alias("comp"))
        both = materialize(rows.join(new.hint("merge"), "sig", "left_anti").select("sig", "row", "comp").union(dealt).distinct(), "dealt")
        apart = both.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig")
        former, rows = rows, materialize(both.join(apart.hint("merge"), "sig", "left_semi"), "open")
        discard(former)
        discard(both)
    return rows, every is not None


def _linked(text: DataFrame, k: int, scheme: Scheme, passes: tuple, carried: int) -> DataFrame:
    """(node, component) of all rows of ``text`` that are linked with another; component is the smallest row."""
    spark, num, den = text.sparkSession, scheme.num, scheme.den
    signed = text.mapInArrow(_sign(k, scheme), "sig long, row long")
    led = signed.repartition(F.col("sig")).sortWithinPartitions("sig").mapInArrow(_lead, "sig long, leader long, row long")
    bucket = materialize(led, "buckets")
    free_shuffles(spark)
    ids = bucket.select("row").union(bucket.select("leader")).distinct()
    sketches = materialize(text.join(ids.hint("merge"), "row", "left_semi").mapInArrow(_sketches(k, scheme, carried), "row long, tag long, n long, sketch array<long>"), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs that are linked. A set with many pairs is held against them in several tasks."""
        pairs = materialize(pairs.select("u", "v"), "pairs")
        stars = pairs.groupBy("u").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")).filter("salts > 1")
        if stars.limit(STARS + 1).count() <= STARS:
            stars = F.broadcast(stars)
        salted = pairs.join(stars, "u", "left").select("u", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "v")
        first = salted.select("u", "salt").distinct().join(text.hint("merge"), F.col("u") == F.col("row")).select("u", "salt", F.lit(0).alias("kind"), F.col("u").alias("v"), "text")
        second = salted.join(text.hint("merge"), F.col("v") == F.col("row")).select("u", "salt", F.lit(1).alias("kind"), "v", "text")
        rows = first.unionByName(second).repartition(F.col("u"), F.col("salt")).sortWithinPartitions("u", "salt", "kind")
        return rows.mapInArrow(_verify(k, num, den), "u long, v long, link boolean").filter("link").select("u", "v")

    shared = bucket.groupBy("row", "leader", F.col("sig").bitwiseAND(_TAGS - 1).alias("tag")).agg(F.count("*").alias("sigs"))
    best = shared.groupBy("row").agg(F.max(F.struct(F.col("sigs"), (-F.col("leader")).alias("minus"), F.col("tag"))).alias("best"))
    best = best.select("row", (-F.col("best.minus")).alias("leader"), "best.tag")
    own = best.join(sketches.hint("merge"), ["row", "tag"])
    near = own.join(sketches.select(F.col("row").alias("leader"), "tag", F.col("n").alias("m"), F.col("sketch").alias("other")).hint("merge"), ["leader", "tag"])
    near = near.filter(_apart(num, den, carried)(F.col("n"), F.col("m"), F.col("sketch"), F.col("other")))
    links = verified(near.select(F.col("leader").alias("u"), F.col("row").alias("v")))
    comp = materialize(components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))), "components")
    free_shuffles(spark)

    # Buckets that still hold different components.
    def labelled(df: DataFrame, col: str, name: str) -> DataFrame:
        known = comp.select(F.col("node").alias(col), F.col("component").alias("__c"))
        return df.join(known.hint("merge"), col, "left").withColumn(name, F.coalesce("__c", col)).drop("__c")

    open_rows = materialize(labelled(labelled(bucket, "row", "comp"), "leader", "lead_comp"), "labelled")
    open_sigs = open_rows.filter("comp <> lead_comp").select("sig").distinct()
    rows = open_rows.join(open_sigs.hint("merge"), "sig", "left_semi")
    rows = materialize(rows.select("sig", "row", "comp").union(rows.select("sig", F.col("leader").alias("row"), F.col("lead_comp").alias("comp")).distinct()), "open")
    discard(open_rows)
    discard(bucket)
    free_shuffles(spark)
    rows, dealt_again = _uncrowded(text, rows, comp, k, scheme)
    rows = rows.withColumn("tag", F.col("sig").bitwiseAND(_TAGS - 1))
    for i, (share, nearest) in enumerate(passes if not rows.isEmpty() else ()):
        chosen = rows.filter(F.pmod(F.xxhash64("sig"), F.lit(share)) == 0)
        counts = chosen.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = chosen.join(counts.hint("merge"), "sig").withColumn("block", F.pmod(F.xxhash64("row", F.lit(i)), "blocks").cast("int"))
        dealt = dealt.withColumn("other", F.col("block") if nearest else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.join(sketches.hint("merge"), ["row", "tag"]).select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "row", "comp", "n", "sketch")
        dealt = dealt.repartition(F.col("sig"), F.col("x"), F.col("y")).sortWithinPartitions("sig", "x", "y")
        more = verified(dealt.mapInArrow(_near(num, den, nearest, carried, not dealt_again), "u long, v long").distinct())
        merged = materialize(components(labelled(labelled(more, "u", "a"), "v", "b").select("a", "b")), "merged")
        free_shuffles(spark)
        if merged.isEmpty():
            continue
        into = merged.select(F.col("node").alias("__from"), F.col("component").alias("__into"))
        moved = comp.join(into.hint("merge"), comp["component"] == into["__from"], "left").select("node", F.coalesce("__into", "component").alias("component"))
        comp = moved.unionByName(merged.join(comp.hint("merge"), "node", "left_anti"))
        if i + 1 == len(passes):
            break
        comp = materialize(comp, "components")
        rows = rows.join(into.hint("merge"), rows["comp"] == into["__from"], "left").select("sig", "row", F.coalesce("__into", "comp").alias("comp"), "tag")
        apart = rows.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig")
        former, rows = rows, materialize(rows.join(apart.hint("merge"), "sig", "left_semi"), "open")
        discard(former)
        free_shuffles(spark)
        if rows.isEmpty():
            break
    return comp


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text", passes: tuple = PLAIN) -> DataFrame:
    """One row for each row of the table ``docs``: doc_id, n_shingles, component_id, n_texts (different sets in the component).

    Defined results: null and empty texts and texts without words have an empty set and a component of their own; texts
    of fewer than k words have their word sequence as the only element; repeated rows are linked as equal sets; a null id
    counts only if a component has no other; an empty table gives no rows; other columns are ignored. ``passes``: PLAIN or
    GROWING, with equal results."""
    found = _grouped(docs, k, num, den, id_col, text_col, passes)
    return found.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_texts")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the table ``docs`` that stay, with their columns: of each component one row, which is the one with the
    smallest id (a null id only if there is no other; of rows that repeat the id, the one whose text's hash is smallest; of
    rows that repeat id and text, any one)."""
    found = _grouped(docs, 5, 75, 100, id_col, text_col, GROWING)
    stays = F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("h"))).alias("stays")
    kept = found.groupBy("component").agg(stays).groupBy(F.col("stays.doc").alias("__winnow_id"), F.col("stays.h").alias("__winnow_h")).agg(F.count("*").alias("__winnow_n"))
    repeats = found.groupBy(F.col("doc").alias("__winnow_id"), F.col("h").alias("__winnow_h")).agg(F.count("*").alias("rows")).filter("rows > 1")
    kept, repeats = materialize(kept, "kept"), materialize(repeats, "repeats")
    same = docs[id_col].cast("long").eqNullSafe(F.col("__winnow_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__winnow_h"))
    rows = docs.join(kept, same, "left_semi")
    if repeats.isEmpty():
        return rows
    # Rows that repeat id and text: as many stay as there are components of theirs (several only of texts without words).
    once = rows.join(repeats, same, "left_anti")
    many = rows.join(repeats, same, "left_semi").withColumn("__winnow_row", F.struct(F.col(id_col).cast("long").alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")))
    one = many.groupBy("__winnow_row").agg(F.first(F.struct(*docs.columns)).alias("row"))
    one = one.join(kept, F.col("__winnow_row.i").eqNullSafe(F.col("__winnow_id")) & (F.col("__winnow_row.h") == F.col("__winnow_h")))
    return once.unionByName(one.select(F.explode(F.array_repeat("row", F.col("__winnow_n").cast("int"))).alias("row")).select("row.*"))
