"""Token ids of a byte-level BPE file, equal to those of ``tokenizers`` and faster.

BPE works inside the pieces of the file's pre-tokenizer, so a piece always gets the same ids. Texts of Latin letters are
cut into pieces here, all texts of a batch at once; each different piece of a batch is merged once, by ``tiktoken`` with the
file's own vocabulary. All other texts, those that hold an added token's string, and all texts of a file with another
pre-tokenizer or other merges go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordhash import flat

#: Letters, numbers and white space of the pre-tokenizer's pattern among the characters below U+0250.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANK = "\t-\r \x85\xa0"
#: What may follow an apostrophe to be a piece with it, and the pre-tokenizer that all this is the rule of.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
RULE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Between different pieces when they are merged; a text that has it goes to the library.
_BETWEEN = "\0"
_OTHER = "[\0\x1c-\x1fɐ-\U0010ffff]"
_CLASS = np.array([next((i for i, x in enumerate((LETTER, NUMBER, BLANK)) if re.match(f"[{x}]", chr(c))), 3) for c in range(0x250)], np.int8)
_BLANK_CLASS, _OTHER_CLASS = 2, 3


def _byte_ranks(written: dict) -> dict[bytes, int] | None:
    """The vocabulary's tokens as bytes, if the file's merges make ids in order; else None."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a file shows as the character of that number
    letter = {chr(c): c for c in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    model = written["model"]
    added = {t["content"] for t in written["added_tokens"]}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in added}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(vocabulary) != 256 + len(pairs) or any(c not in letter for k in vocabulary for c in k):
        return None
    return {bytes(letter[c] for c in k): v for k, v in vocabulary.items()}


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts without other characters, one text after the other, and where each text's begin."""
    data, at = flat(texts)
    code = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    byte = np.cumsum(np.r_[0, 1 + (code >= 0x80) + (code >= 0x800)])
    starts = np.searchsorted(byte, at)
    n = len(code)
    kind = _CLASS[code]
    text_end = np.zeros(n + 1, bool)
    text_end[starts] = True
    begins = np.ones(n + 1, bool)
    begins[1:n] = (kind[1:] != kind[:-1]) | text_end[1:n]
    run = np.flatnonzero(begins)  # the last one is the end of all
    first, end = run[:-1], run[1:]
    inside = ~text_end[end]
    # The last of several blanks stands alone before other characters; a space goes to what follows it.
    blank = end[(kind[first] == _BLANK_CLASS) & inside]
    begins[blank - 1] = True
    begins[blank[code[blank - 1] == 32]] = False
    # An apostrophe that nothing else of its class is beside and no space before takes one of ENDINGS from the letters after it.
    quote = (code[first] == 39) & (end - first == 1) & inside & begins[first]
    after, letters = end[quote], (end[1:][quote[:-1]] if len(end) > 1 else end[:0])
    for ending in ENDINGS:
        fits = letters - after >= len(ending)
        for j, c in enumerate(ending):
            fits[fits] = code[after[fits] + j] == ord(c)
        begins[after[fits]] = False
        begins[after[fits] + len(ending)] = True
        after, letters = after[~fits], letters[~fits]
    piece = np.flatnonzero(begins[:n])
    offsets = byte[np.r_[piece, n]].astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(piece, starts)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        written = json.loads(self.tokenizer.to_str())
        rule, model = written.get("pre_tokenizer") or {}, written["model"]
        plain = written.get("normalizer") is None and {k: rule.get(k) for k in RULE} == RULE
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        ranks = _byte_ranks(written) if plain else None
        self.merge = None
        if ranks:
            import tiktoken

            self.merge = tiktoken.Encoding("winnow", pat_str=f"{_BETWEEN}|[^{_BETWEEN}]+", mergeable_ranks=ranks, special_tokens={})
            self.between = ranks[_BETWEEN.encode()]
        self.special = "|".join([_OTHER, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.merge is None:
            return self._whole(texts.to_pylist())
        whole = pc.match_substring_regex(texts, self.special)
        out: list[bytes] = [b""] * len(texts)
        special = whole.to_numpy(zero_copy_only=False)
        for i, ids in zip(np.flatnonzero(special).tolist(), self._whole(texts.filter(whole).to_pylist()), strict=True):
            out[i] = ids
        pieces, first = cut(texts.filter(pc.invert(whole)))
        if len(pieces):
            numbered = pieces.dictionary_encode()
            merged = np.array(self.merge.encode_ordinary(_BETWEEN.join(numbered.dictionary.to_numpy(zero_copy_only=False))), "<u4")
            ends = np.r_[np.flatnonzero(merged == self.between), len(merged)]
            begins = np.r_[0, ends[:-1] + 1]
            number = numbered.indices.to_numpy()
            size, begin = (ends - begins)[number], begins[number]
            to = np.cumsum(size)
            ids = merged[np.repeat(begin - to + size, size) + np.arange(to[-1])]
            at = np.r_[0, to][first]
            for k, i in enumerate(np.flatnonzero(~special).tolist()):
                out[i] = ids[at[k] : at[k + 1]].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each Python process."""
    return Encoder(path)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
