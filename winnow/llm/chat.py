"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: a start mark, then for each turn its role between two marks, its text, and an end mark.
Marks are added to the tokenizer as special tokens, so no token crosses a mark. What looks like a mark inside a role or a
text is escaped by a backslash after its bracket, reversibly. The rendered text is encoded once with offsets, and the
tokens under the loss are found by intersecting the sorted spans of the assistant's texts with the sorted token spans by
binary search.

Rows are sorted by conversation and turn and streamed, so memory follows one part of a conversation: one of more than
``PART`` characters is encoded in parts that end between turns, which gives the same tokens, as marks separate them.

Defined results: null texts and roles are empty; rows with a null conversation form one; null turns come first and equal
turns are ordered by role, then text; repeated rows are repeated turns; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path

#: The template's marks.
BEGIN, END, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
PART = 1 << 21

_PLAIN = re.compile(r"([<\[]\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[]\\*)\\(/?(?:s>|INST\]))")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    """One more backslash between the bracket and the rest of anything that reads as a mark, escaped or not."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]], begin: bool = True, loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of the texts that the loss is for."""
    out, spans, at = [BEGIN] if begin else [], [], len(BEGIN) * begin
    for role, text in turns:
        own = escape(text)
        head = ROLE + escape(role) + TEXT
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(own)))
        out.append(head + own + END)
        at += len(head) + len(own) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@lru_cache(4)
def chat_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets that keep blanks
    tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (BEGIN, END, ROLE, TEXT)])
    return tokenizer


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it lies under a span. Tokens and spans are sorted; each span's tokens are found by binary search."""
    mask = np.zeros(len(offsets), bool)
    if spans and len(offsets):
        bounds = np.array(spans)
        low = np.searchsorted(offsets[:, 1], bounds[:, 0], "right")
        high = np.searchsorted(offsets[:, 0], bounds[:, 1], "left")
        for a, b in zip(low, high, strict=True):
            mask[a:b] = True
    return mask


def under_mask(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The characters of the tokens under the mask, each once (a character may have several tokens)."""
    out, end = [], 0
    for a, b in offsets[mask].tolist():
        if b > end:
            out.append(formatted[max(a, end) : b])
            end = b
    return "".join(out)


def format_chats(rows: DataFrame, tokenizer: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each part of a conversation (nearly always one): conv_id, part, last, formatted, ids, mask, spans."""
    path = tokenizer or tokenizer_path()
    schema = "conv_id long, part int, last boolean, formatted string, ids array<int>, mask array<boolean>, offsets array<int>"
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sorted_rows = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        names = ["conv_id", "part", "last", "formatted", "ids", "mask", "offsets"]
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
        out: list[tuple] = []

        def flush(conv, part, last, turns) -> None:
            text, spans = render(turns, part == 0)
            code = chat_tokenizer(path).encode(text, add_special_tokens=False)
            offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
            out.append((conv, part, last, text, code.ids, masked(offsets, spans).tolist(), offsets.ravel()))

        def ready() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return b

        began, conv, part, size, turns = False, None, 0, 0, []
        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if began and c != conv:
                    flush(conv, part, True, turns)
                    part, size, turns = 0, 0, []
                elif size > PART:
                    flush(conv, part, False, turns)
                    part, size, turns = part + 1, 0, []
                began, conv, size = True, c, size + len(role) + len(text)
                turns.append((role, text))
                if len(out) >= 64 or out and not out[-1][2]:
                    yield ready()
        if began:
            flush(conv, part, True, turns)
        if out:
            yield ready()

    return sorted_rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from what ``format_chats`` wrote: parts of a conversation follow each other there."""

    def run(batches):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        out: list[list] = [[] for _ in names]
        state = None
        for b in batches:
            for conv, part, last, text, mask, offsets in zip(*(b.column(k).to_pylist() for k in ("conv_id", "part", "last", "formatted", "mask", "offsets")), strict=True):
                if part == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                spans = np.array(offsets, np.int32).reshape(-1, 2)
                loss = unescape_each(text, spans, np.array(mask, bool))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += len(mask)
                state[6] += sum(mask)
                if last:
                    for column, v in zip(out, (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, out, strict=True)], names=names)
            out = [[] for _ in names]

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def unescape_each(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask; each run of masked tokens is unescaped by itself, so texts do not join into a mark."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return "".join(unescape(under_mask(formatted, offsets[a:b], mask[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True))
