"""The pipeline's stages over a small table, each against plain Python."""

import itertools
import random
import re

import corpus_pipeline
from winnow.llm import storage
from winnow.llm.tokens import encoder, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "su", "ta") for b in ("nar", "dol", "vik", "pes", "rum", "tog", "zan", "hil")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(n) for n in (3, 12, 40, 40, 60, 60, 90, 400, 1500, 25, 25, 25)]
    near = []
    for i in (3, 5, 6):
        w = base[i].split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    items = [text(14), text(6), text(30)]
    leaked = [f"{text(20)} {items[0]} {text(9)}", f"{text(5)} {items[1].upper()}", f"{text(8)} {' '.join(items[2].split()[10:21])} {text(3)}"]
    partial = f"{text(8)} {' '.join(items[2].split()[:9])} {text(30)}"  # one word less than a window
    texts = [*base, *near, *leaked, partial, base[2], base[4], base[4], None, "", "12 % 34 --", near[0]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i], rng.choice(["en", "de"]), f"s{i}", len(texts[i] or "")) for k, i in enumerate(order)]
    return [*rows, rows[0], (None, base[9], "en", "null id", 1), (None, "alone " + text(20), "de", "null id", 2)], items


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def with_language(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def without_copies(rows):
    best = {}
    for r in rows:
        if r[1] not in best or (-1 if r[0] is None else r[0]) > (-1 if best[r[1]][0] is None else best[r[1]][0]):
            best[r[1]] = r
    return list(best.values())


def without_near_copies(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return [r for k, r in enumerate(rows) if r[0] == min((s[0] for i, s in enumerate(rows) if group[i] == group[k] and s[0] is not None), default=None)]


def without_benchmark(rows, items):
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(split, items) for i in range(len(w) - min(10, len(w)) + 1)}
    found = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    return [r for r in rows if not found(split(r[1]))]


def test_stages(spark, tmp_path):
    rows, items = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = [with_language, without_copies, without_near_copies, lambda x: without_benchmark(x, items)]
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for (name, stage), expect in zip(corpus_pipeline.STAGES, plain, strict=False):
        before, want = len(want), expect(want)
        docs = storage.materialize(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str), name
        assert 0 < len(want) < before, name
    name, stage = corpus_pipeline.STAGES[len(plain)]
    pieces = stage(spark, docs, str(tmp_path)).collect()
    enc = encoder(tokenizer_path())
    lengths = {r[0]: len(enc.tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}
    cover = {}
    for r in pieces:
        cover.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    assert cover.keys() == lengths.keys() and any(len(c) > 1 for c in cover.values())
    for doc, parts in cover.items():
        assert [0, *(z for _, z in sorted(parts))] == [*(a for a, _ in sorted(parts)), lengths[doc]]
    for _, own in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in pieces), key=lambda x: x[0]):
        at = 0
        for _, offset, n in own:
            assert offset == at
            at += n
        assert at <= 1024
    assert len(corpus_pipeline.STAGES) == len(plain) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
