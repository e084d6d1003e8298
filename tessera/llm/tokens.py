"""Token ids of whole texts with a public tokenizer file, through the distinct words of a batch of them.

A byte-level BPE never merges across pre-tokens, and a space after anything but white space begins one. So the ids
of a text are those of what its spaces part, each with the space before it, and a batch needs them for each distinct
word only. Texts where a space follows white space, ends the text, or stands among other than plain characters
(below) are encoded whole, those of other characters by the ``tokenizers`` library.

Where the file's merges are in the order of their ids, a pre-token's ids follow from the ranks alone; then the
ranks are read from the same file and ``tiktoken`` merges pre-tokens, which costs a third. The ids are equal.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Plain characters, of which letters are A-Z, a-z and U+00C0-U+017F but for two signs; tables of characters agree on them.
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN = re.compile(f"[\t\n\r -~{LETTER}]*")
#: texts that are not what their spaces part
WHOLE = rf"[\t\n\r ] | \z|[^\t\n\r -~{LETTER}]"
#: the public pre-token pattern, and one without lookahead that agrees where no white space follows white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")
#: white space in a row, and from where on the library takes the text: looking ahead of a million is an error of the other
ROW, LONG_ROW = re.compile(r"\s\s+"), 10_000
#: first words to remember, their length at most; words to encode at once
CACHE, LONGEST = 50_000, 64
AT_ONCE = 50_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merger:
    """Ids of plain text by ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.any, self.single = (tiktoken.Encoding("merger", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, SINGLE))
        #: ids of tokens that begin with a space
        self.spaced = np.zeros(len(ranks), bool)
        self.spaced[[i for token, i in ranks.items() if token.startswith(b" ")]] = True

    def __call__(self, text: str) -> np.ndarray | None:
        """None if the text has too much white space in a row."""
        row = max((m.end() - m.start() for m in ROW.finditer(text)), default=0)
        return np.array((self.any if row else self.single)(text), "<u4") if row < LONG_ROW else None


def merger(path: str) -> Merger | None:
    """Ids by ranks, or None if the file's merges are not in id order."""
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    vocab, letters = model["vocab"], byte_letters()
    for i, m in enumerate(model["merges"]):
        if vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) != 256 + i:
            return None
    try:
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(model["merges"])}
    except KeyError:
        return None
    if sorted(ranks.values()) != list(range(len(ranks))):
        return None
    return Merger(ranks)


class Ids:
    """Encoder over one tokenizer file; ``path`` is a parameter, the file is never copied."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: ids of words that began a text
        self.cache: dict[str, bytes] = {}
        self.merge = merger(path)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        return self.many(pa.array([text], pa.large_string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; those of null are none."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for rows, encode in ((np.flatnonzero(whole), self.whole), (np.flatnonzero(~whole), self.by_words)):
            if len(rows):
                for row, ids in zip(rows.tolist(), encode(texts.take(pa.array(rows))), strict=True):
                    out[row] = ids
        return out

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def plain(self, text: str) -> np.ndarray:
        ids = self.merge(text) if self.merge else None
        return self.library(text) if ids is None else ids

    def whole(self, texts: pa.Array) -> list[bytes]:
        """Ids of any texts."""
        return [(self.plain if PLAIN.fullmatch(t) else self.library)(t).tobytes() for t in texts.to_pylist()]

    def first(self, word: str) -> bytes:
        """Ids of a plain word that begins a text."""
        ids = self.cache.get(word)
        if ids is None:
            ids = self.plain(word).tobytes()
            if len(word) <= LONGEST:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = ids
        return ids

    def after_space(self, words: pa.Array) -> pa.Array:
        """Ids of plain words that have no space, each with a space before it."""
        made = [pa.array([], pa.large_binary())]
        for k in range(0, len(words), AT_ONCE):
            part = words.slice(k, AT_ONCE)
            if not self.merge:
                made.append(pa.array([self.library(f" {w}").tobytes() for w in part.to_pylist()], pa.large_binary()))
                continue
            one = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            ids = self.plain(" " + pc.binary_join(one, pa.scalar(" ", part.type))[0].as_py())
            # the only space of a word's ids is at their beginning
            ends = np.append(np.flatnonzero(self.merge.spaced[ids]), len(ids)).astype("<i8") * 4
            if len(ends) != len(part) + 1:
                raise ValueError("a word's ids do not begin with its space")
            made.append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
        return pa.concat_arrays(made)

    def by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that are what their spaces part."""
        parted = pc.split_pattern(texts, " ")
        n = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
        words, ends = parted.flatten(), np.cumsum(n)
        firsts = words.take(pa.array(ends - n)).to_pylist()
        later = np.ones(len(words), bool)
        later[ends - n] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        ids = self.after_space(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, "<i8")[np.append(0, np.cumsum(n - 1))].tolist() if len(ids) else [0] * (len(n) + 1)
        view = memoryview(data or b"")
        return [self.first(w) + view[i:j] for w, i, j in zip(firsts, at, at[1:], strict=False)]


_encoders: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Ids(path)
    return _encoders[path]
