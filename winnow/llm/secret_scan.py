"""Secret scanning with DataFrame functions only.

Three kinds of known shapes are matched by patterns. Beside them, every run of at least ``WINDOW`` characters that can be
part of a key is a candidate: a window of that length slides over it. The counts of the window's characters are kept, one for
each character of the alphabet, and the window's Shannon entropy with them: one character enters, one leaves, and only
their two terms change. The characters a candidate has decide its class
and so the entropy asked for; from the first to the last window that reaches it, the candidate is a span of kind
"entropy", unless the allow-list knows it.

Positions follow from the lengths of the texts between matches: a text is split at the matches and both lists are zipped.
Lengths are summed up in blocks of matches, so that many matches in a text cost little more each than few.
Everything is an expression of the row, so there is no shuffle. The entropy is computed in whole millionths, so results
don't depend on rounding.

Defined results: null and empty texts have no spans; repeated rows are scanned each; an empty table gives no rows; other
columns are ignored; an id column that is named as a result is called doc_id there. Positions are code points, the end
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the known kinds; (kind, pattern, group whose length counts, least length).
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
WINDOW = 20
CANDIDATE = r"([A-Za-z0-9+/_=-]{20,})"
#: (class, pattern of the whole candidate, least entropy of a window in bits a character), the first that matches counts.
CLASSES = [("hex", "^[0-9A-Fa-f]+$", 3.0), ("alphanumeric", "^[A-Za-z0-9]+$", 3.6), ("symbols", "", 3.8)]
#: Candidates that are no secrets: without a digit, without a letter, UUIDs, counted-up alphabets, words of documentation.
ALLOWED = [
    "^[^0-9]+$",
    "^[^A-Za-z]+$",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "0123456789|abcdefghij|ABCDEFGHIJ",
    "[Ee]xample|EXAMPLE|[Pp]laceholder|PLACEHOLDER|[Cc]hangeme|CHANGEME|[Dd]ummy|DUMMY",
]
#: Windows of a candidate that are computed in one go; bounds the cost of finding a character's place.
STEP = 180
#: Matches whose positions are summed up in one go.
BLOCK = 64
#: Characters of candidates; counts are kept in their order, as characters from NONE on.
ALPHABET = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123))) + "+/_=-"
NONE = 32

#: n * log2(n) in millionths, for n = 0 to WINDOW, and what one more adds to it.
TERM = [0] + [round(1e6 * n * log2(n)) for n in range(1, WINDOW + 1)]
MORE = [b - a for a, b in zip(TERM, TERM[1:])]


def limit(bits: float) -> int:
    """The sum of n * log2(n) over a window's characters, in millionths, up to which its entropy is at least ``bits``."""
    return round(1e6 * WINDOW * (log2(WINDOW) - bits))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, text) of the matches in order; null for a text without any."""
    whole = re.fullmatch(r"\([^()?][^()]*\)", pattern) is not None  # the group is all that matches
    lists = [F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))]
    zipped = F.arrays_zip(*lists, *([] if whole else [F.regexp_extract_all(text, F.lit(pattern), F.lit(group))]))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")

    def width(x: Column) -> Column:
        return (F.length(x["0"]) + F.coalesce(F.length(x["1"]), F.lit(0))).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["0"]), acc["at"] + width(x)
        found = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["1"].alias("text")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(x["1" if whole else "2"]) >= least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def blocks(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda i: F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)))

    def starts(cut: Column) -> Column:
        sizes = F.transform(cut, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda total, row: total + width(row)))
        return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def places(cut: Column, at: Column) -> Column:
        return F.flatten(F.transform(cut, lambda x, i: F.aggregate(x, F.struct(F.get(at, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    found = _bound(zipped, lambda rows: _bound(blocks(rows), lambda cut: _bound(starts(cut), lambda at: places(cut, at))))
    return F.when(text.rlike(pattern), found)


def _hot_windows(part: Column, most: Column) -> Column:
    """(first, last): start of the first and end of the last window of ``part`` with a sum of at most ``most``; -1 if there is none."""
    more = F.array(*(F.lit(x) for x in MORE))

    def place(i: Column) -> Column:
        return F.position(F.substr(part, i, F.lit(1)), F.lit(ALPHABET))

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substr(counts, at, F.lit(1))) - NONE

    def step(acc: Column, i: Column) -> Column:
        """One character enters and, once the window is full, one leaves."""

        def entered(at: Column) -> Column:
            n = count(acc["counts"], at)
            return F.struct(F.overlay(acc["counts"], F.char(n + (NONE + 1)), at, F.lit(1)).alias("counts"), (acc["sum"] + F.get(more, n)).alias("sum"))

        def left(new: Column, at: Column) -> Column:
            n = count(new["counts"], at)
            return F.struct(F.overlay(new["counts"], F.char(n + (NONE - 1)), at, F.lit(1)).alias("counts"), (new["sum"] - F.get(more, n - 1)).alias("sum"))

        new = _bound(place(i), entered)
        return F.when(i > WINDOW, _bound(new, lambda x: _bound(place(i - WINDOW), lambda at: left(x, at)))).otherwise(new)

    def judged(acc: Column, i: Column) -> Column:
        def judge(new: Column) -> Column:
            hot = (i >= WINDOW) & (new["sum"] <= most)
            return F.struct(
                new["counts"].alias("counts"),
                new["sum"].alias("sum"),
                F.when(hot & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).cast("int").alias("first"),
                F.when(hot, i).otherwise(acc["last"]).cast("int").alias("last"),
            )

        return _bound(step(acc, i), judge)

    start = F.struct(F.lit(chr(NONE) * len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(F.sequence(F.lit(1), F.length(part)), start, judged, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_span(c: Column) -> Column:
    """(start, end) of a candidate's span, -1 for none."""
    most = F.lit(None).cast("long")
    for _, pattern, bits in reversed(CLASSES):
        most = F.when(c["text"].rlike(pattern), limit(bits)).otherwise(most) if pattern else F.lit(limit(bits))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(c["text"]) - WINDOW) / STEP).cast("int")),
        lambda k: F.struct((k * STEP).alias("at"), _hot_windows(F.substr(c["text"], k * STEP + 1, F.lit(STEP + WINDOW - 1)), most).alias("hot")),
    )
    none = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))

    def join(acc: Column, x: Column) -> Column:
        hot = x["hot"]["first"] >= 0
        return F.struct(
            F.when(hot & (acc["start"] < 0), c["start"] + x["at"] + x["hot"]["first"]).otherwise(acc["start"]).cast("long").alias("start"),
            F.when(hot, c["start"] + x["at"] + x["hot"]["last"]).otherwise(acc["end"]).cast("long").alias("end"),
        )

    return F.aggregate(chunks, none, join)


def _id_name(id_col: str) -> str:
    """The id column's name in results."""
    taken = {"entropy", "spans", "base_sha256", *(k for k, *_ in KINDS), *(f"n_{k}" for k, *_ in KINDS)}
    return "doc_id" if id_col in taken else id_col


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, of each kind and of "entropy", an array of (start, end); null where a text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    candidates = F.filter(_matches(text, CANDIDATE, 1, WINDOW), lambda c: ~F.greatest(*(c["text"].rlike(p).cast("int") for p in ALLOWED)).cast("boolean"))
    only = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hot = F.filter(F.transform(candidates, _entropy_span), lambda s: s["start"] >= 0)
    return docs.select(F.col(id_col).alias(_id_name(id_col)), *(only(_matches(text, p, g, n)).alias(kind) for kind, p, g, n in KINDS), only(hot).alias("entropy"))


def _joined(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def tagged(i: int, kind: str) -> Column:
        return F.coalesce(F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))), none)

    each = [tagged(i, k) for i, k in enumerate(kinds)]
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = [k for k, *_ in KINDS]
    counts = [F.when(F.col(k).isNull(), 0).otherwise(F.size(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select(F.col(_id_name(id_col)), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined([*base, "entropy"]).alias("spans"))
