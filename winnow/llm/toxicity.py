"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4, 5 and 6 bytes, two slots each. Filters of one, two
and three words run over the text, the strongest answer of each is kept (max pooling), and a logistic layer weighs them.
The score is calibrated by language: the texts' function words tell a language group (the column ``lang`` is not read),
and the logit's threshold is that of the group, so 0.5 is the best cut of each group's calibration texts.

A group's threshold lies between its own best cut and that of all texts, the nearer to its own the more calibration texts
it has (``PRIOR`` of its rarer label count as much as all texts). The fit takes ``STEPS`` steps over a bounded sample of the labelled rows (``MAX_TRAIN``). Defined results: null and empty texts and texts
without words get the score of the bias alone; repeated rows count each; without training rows every score is 0; an empty
table gives no rows; other columns are kept, but for one that is named as the score, which takes its place. Whole texts are read, in chunks of ``CHUNK`` words, so a worker's memory does not follow the text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .wordhash import mix, slices, words

#: Labelled rows of each label that the fit reads, about.
MAX_TRAIN = 3_000
#: Steps of the fit and texts in each, at every size of the sample.
STEPS, BATCH = 1500, 16
PRIOR = 20
CHUNK = 1 << 15
WIDTHS = (1, 2, 3)
DIM, FILTERS, SLOTS = 12, 16, 1 << 15
PREFIXES = (4, 5, 6)

#: Frequent function words of some languages.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu von mit den auf für im dem",
    "en": "the of and to is in that it was for on are as with be this",
    "es": "el los las y que en un una por con para del se su al como",
    "fr": "le la les et des une du dans est pour que qui sur au pas avec",
}

_U = np.uint64


def _group_words() -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted((int(h), g) for g, x in enumerate(FUNCTION_WORDS.values()) for h in words(pa.array([x]), "alnum").hash)
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of each word (8 columns), each text's first word, and each text's language group."""
    w = words(texts, "alnum", PREFIXES)
    columns = []
    for i, h in enumerate((w.hash, *w.prefixes)):
        for j in range(2):
            columns.append((mix(h + _U(j)) >> _U(64 - 15)).astype(np.int32) + SLOTS * i)
    keys, group = _group_words()
    k = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
    hit = np.flatnonzero(keys[k] == w.hash)
    doc = np.searchsorted(w.first, hit, "right") - 1
    n = np.zeros((len(texts), len(FUNCTION_WORDS)), np.int64)
    np.add.at(n, (doc, group[k[hit]]), 1)
    groups = np.where(n.any(axis=1), n.argmax(axis=1), len(FUNCTION_WORDS))
    return np.stack(columns, axis=1) if len(w.hash) else np.empty((0, 8), np.int32), w.first, groups


def _embedded(embed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    x = embed[slots[:, 0]]
    for j in range(1, slots.shape[1]):
        x += embed[slots[:, j]]
    return x


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    def pooled(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Strongest answer of each filter in each text, at least 0."""
        best = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        n, most = len(slots), max(WIDTHS)
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK + most - 1)
            x = _embedded(self.embed, slots[lo:hi])
            ends = first[np.searchsorted(first, np.arange(lo, hi), "right")]
            for k, width in enumerate(WIDTHS):
                m = hi - lo - width + 1
                if m <= 0:
                    continue
                y = sum(x[j : j + m] @ self.filters[k][j * DIM : (j + 1) * DIM] for j in range(width)) + self.bias[k]
                y[np.arange(lo, lo + m) + width > ends[:m]] = 0
                cut = np.clip(first, lo, lo + m)
                full = np.flatnonzero(cut[1:] > cut[:-1])
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                best[full, own] = np.maximum(best[full, own], np.maximum.reduceat(y, cut[:-1][full] - lo, axis=0))
        return best

    def logits(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(slots, first) @ self.out + self.out_bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        slots, first, groups = features(texts)
        z = self.logits(slots, first) - self.thresholds[groups]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def train(texts: list[str | None], labels: np.ndarray, steps: int = STEPS, rate: float = 0.05, batch: int = BATCH, seed: int = 7) -> Model:
    """Adagrad over the texts; one in five is kept out for the thresholds."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (SLOTS * (1 + len(PREFIXES)), DIM)).astype(np.float32),
        [rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0,
    )
    slots, groups = [], []
    for i in range(0, len(texts), 256):
        s, first, g = features(pa.array(texts[i : i + 256], pa.string()))
        slots += [s[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        groups += g.tolist()
    labels, groups = labels.astype(np.float32), np.array(groups)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    weight = np.where(labels == 1, 0.5 / max(1e-6, labels[fit].mean()), 0.5 / max(1e-6, 1 - labels[fit].mean()))
    g_embed, g_dense = np.full(len(model.embed), 1e-3, np.float32), [[np.full(x.shape, 1e-3, np.float32) for x in xs] for xs in (model.filters, model.bias, [model.out])]
    g_bias = 1e-3

    def step(value: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        seen += grad * grad
        value -= rate * grad / np.sqrt(seen)

    while steps and len(fit):
        fit = rng.permutation(fit)
        for lo in range(0, min(len(fit), steps * batch), batch):
            steps -= 1
            d_filter, d_bias, d_out, d_out_bias = [np.zeros_like(x) for x in model.filters], [np.zeros_like(x) for x in model.bias], np.zeros_like(model.out), 0.0
            at_slot, at_grad = [], []
            for i in fit[lo : lo + batch]:
                s = slots[i]
                x = _embedded(model.embed, s)
                pool, where, wide = np.zeros(FILTERS * len(WIDTHS), np.float32), [], []
                for k, width in enumerate(WIDTHS):
                    m = len(x) - width + 1
                    if m <= 0:
                        where.append(None)
                        wide.append(None)
                        continue
                    y = sum(x[j : j + m] @ model.filters[k][j * DIM : (j + 1) * DIM] for j in range(width)) + model.bias[k]
                    top = y.argmax(axis=0)
                    pool[k * FILTERS : (k + 1) * FILTERS] = np.maximum(y[top, np.arange(FILTERS)], 0)
                    where.append(top)
                    wide.append(np.concatenate([x[top + j] for j in range(width)], axis=1))
                z = float(pool @ model.out + model.out_bias)
                g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[i]) * weight[i] / batch
                d_out += g * pool
                d_out_bias += g
                d_pool = g * model.out * (pool > 0)
                for k, width in enumerate(WIDTHS):
                    if where[k] is None:
                        continue
                    d = d_pool[k * FILTERS : (k + 1) * FILTERS]
                    d_filter[k] += wide[k].T * d
                    d_bias[k] += d
                    back = model.filters[k].T * d[:, None]
                    live = np.flatnonzero(d)
                    for j in range(width):
                        at_slot.append(s[where[k][live] + j])
                        at_grad.append(back[live, j * DIM : (j + 1) * DIM])
            for k in range(len(WIDTHS)):
                step(model.filters[k], g_dense[0][k], d_filter[k])
                step(model.bias[k], g_dense[1][k], d_bias[k])
            step(model.out, g_dense[2][0], d_out)
            g_bias += d_out_bias**2
            model.out_bias -= rate * d_out_bias / g_bias**0.5
            if at_slot:
                every = np.concatenate(at_slot).ravel()
                order = np.argsort(every, kind="stable")
                rows, begins = np.unique(every[order], return_index=True)
                total = np.add.reduceat(np.concatenate(at_grad)[order // (2 * (1 + len(PREFIXES)))], begins, axis=0) if len(rows) else np.zeros((0, DIM), np.float32)
                g_embed[rows] += (total * total).mean(axis=1)
                model.embed[rows] -= rate * total / np.sqrt(g_embed[rows])[:, None]
    z = np.array([model.logits(slots[i], np.array([0, len(slots[i])]))[0] for i in held])
    whole = _threshold(z, labels[held])
    for g in range(len(model.thresholds)):
        own = groups[held] == g
        n = min((labels[held][own] == 1).sum(), (labels[held][own] == 0).sum())
        model.thresholds[g] = (n * _threshold(z[own], labels[held][own]) + PRIOR * whole) / (n + PRIOR)
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap between the logits beside it."""
    order = np.argsort(-z)
    z, y = z[order], y[order]
    if not y.any():
        return float(z.max(initial=0) + 1)
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model | None:
    """A model from about ``max_train`` rows of each label, chosen by a hash; None unless both labels occur."""
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    chance = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20))
    part = F.when(F.col("label") == 1, int((1 << 20) * min(1, max_train / n[1]))).otherwise(int((1 << 20) * min(1, max_train / n[0])))
    table = rows.filter(chance < part).toArrow()  # about two times max_train rows
    order = np.lexsort((np.array([hash_text(t) for t in table.column(0).to_pylist()], np.uint64), table.column(1).to_numpy()))
    table = table.take(pa.array(order))
    return train(table.column(0).to_pylist(), table.column(1).to_numpy())


def choose(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """About ``max_train`` rows of each label (0 or 1), chosen by a hash of the id before any text is joined: (id, label),
    small enough to broadcast at every size. Null ids are left out."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(id_col, label_col)
    n = {r[0]: r[1] for r in known.groupBy(label_col).agg(F.count("*")).collect()}
    part = F.when(F.col(label_col) == 1, int((1 << 20) * min(1, max_train / n.get(1, 1)))).otherwise(int((1 << 20) * min(1, max_train / n.get(0, 1))))
    return known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < part)


def hash_text(text: str | None) -> int:
    """For an order of the sample that does not depend on the order in which rows arrive."""
    import zlib

    return zlib.crc32((text or "").encode("utf-8", "surrogatepass"))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without its text column, with the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text_col, name)]

    def run(batches):
        for b in slices(batches, 128):
            own = shared.value.scores(b.column(len(kept))) if shared.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(own, pa.float64())], names=[*kept, name])

    schema = StructType([*docs.select(*kept).schema.fields, StructField(name, DoubleType())])
    return docs.select(*kept, text_col).mapInArrow(run, schema)
