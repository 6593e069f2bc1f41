"""Whole-text encoding with a public tokenizer, fast on prose.

The ids are those of the tokenizers library with add_special_tokens=False.
Its own encoder takes more than the time at hand, so the same merges also run
in tiktoken's faster loop, built from the vocabulary in the tokenizer's file:

* byte-level vocabularies: the whole text at once;
* vocabularies with word ends: texts are cut at spaces and line ends, where
  such a tokenizer starts anew. A worker keeps the ids of words that come again;
  new plain words take the fast loop with a marker byte as word end, all others
  the library.

A text that holds the string of an added token goes to the library whole, for
the loops cannot produce such a token. Each worker first encodes its first texts both ways and stays with the library
if they ever differ.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

MARK = "\x00"
#: What may stand behind a plain word, as one piece; an apostrophe can begin a piece of its own.
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Characters of text that are cut into words at a time.
SEGMENT = 1 << 20
#: Words in the young half of a worker's cache; what is used again moves over from the old half.
WORDS = 250_000
#: Longer words are encoded each time.
LONGEST = 64
#: Texts a worker encodes both ways at first.
TRIED = 32


def byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def segments(text: str):
    """The text in parts of some SEGMENT characters, cut at spaces."""
    at = 0
    while len(text) - at > SEGMENT and (end := text.find(" ", at + SEGMENT)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


class Encoder:
    """texts -> little-endian unsigned 32-bit ids. Strings of special tokens in a text are those tokens with added, else text."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = spec.get("added_tokens", []) if added else []
        self.added = [x["content"] for x in tokens]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tried = 0
        # an added token that is sought in the normalized text can't be found by its string
        self.fast = None if any(x.get("normalized") for x in tokens) else self._fast(spec)

    def _fast(self, spec: dict):
        """tiktoken's loop over the same merges, or None."""
        import tiktoken

        byte, vocab = byte_of(), spec["model"]["vocab"]
        added = {x["content"] for x in spec.get("added_tokens", [])}
        try:
            tokens = {(bytes(byte[c] for c in t.removesuffix(self.suffix)) + MARK.encode() * t.endswith(self.suffix) if self.suffix else bytes(byte[c] for c in t)): i for t, i in vocab.items() if t not in added}
        except KeyError:
            return None
        self.ids = np.zeros(len(tokens) + 1, np.uint32)
        self.ends = np.zeros(len(tokens) + 1, bool)
        if not self.suffix:
            self.ids = None
            return tiktoken.Encoding("bytes", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=tokens, special_tokens={})
        # a letter with its word end is one symbol from the start: those come first, single bytes last
        order = sorted(tokens, key=lambda t: ((1, tokens[t]) if len(t) > 2 or (len(t) == 2 and t[1:] != MARK.encode()) else (0, tokens[t]) if len(t) == 2 else (2, tokens[t])))
        ranks = {t: k for k, t in enumerate(order)}
        for t, k in ranks.items():
            self.ids[k], self.ends[k] = tokens[t], t.endswith(MARK.encode())
        return tiktoken.Encoding("words", pat_str=rf"[^{MARK}]*{MARK}", mergeable_ranks=ranks, special_tokens={})

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _plain(self, word: str) -> str | None:
        """The word with marks after its parts, if it is letters, perhaps with punctuation behind."""
        body = word.rstrip(PUNCTUATION)
        if not body.isalpha():
            return None
        low = body.lower()
        if not body.isascii() and not ((low == body or (max(body) < "\u0250" and "\u0130" not in body)) and unicodedata.is_normalized("NFC", body)):
            return None
        return f"{low}{MARK}{word[len(body) :]}{MARK}" if len(body) < len(word) else low + MARK

    def _words(self, words: list[str]) -> dict[str, bytes]:
        marked = [self._plain(x) for x in words] if self.fast else [None] * len(words)
        odd = [x for x, m in zip(words, marked, strict=True) if m is None]
        out = dict(zip(odd, self._library(odd), strict=True)) if odd else {}
        plain = [(x, m) for x, m in zip(words, marked, strict=True) if m is not None]
        if plain:
            ids = np.asarray(self.fast.encode_ordinary("".join(m for _, m in plain)), np.int64)
            parts = np.cumsum([m.count(MARK) for _, m in plain])
            cuts = np.flatnonzero(self.ends[ids])[parts - 1] + 1
            data, at = self.ids[ids].astype("<u4").tobytes(), 0
            for (x, _), end in zip(plain, (cuts * 4).tolist(), strict=True):
                out[x] = data[at:end]
                at = end
        return out

    def _cut(self, segments: list[str]) -> list[bytes]:
        """The ids of segments, word by word."""
        cut = [x.split(" ") for x in segments]
        if len(self.young) > WORDS:
            self.young, self.old = {}, self.young
        missing = set().union(*cut).difference(self.young)
        kept = {x for x in missing if x in self.old}  # intersection() would walk through all of old
        self.young.update({x: self.old[x] for x in kept})
        found = self._words(list(missing - kept))
        self.young.update(found)
        out = [b"".join(map(self.young.__getitem__, c)) for c in cut]
        for x in [x for x in found if len(x) > LONGEST]:
            del self.young[x]
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        out, group, size = [[] for _ in texts], [], 0

        def put():
            for (i, _), ids in zip(group, self._cut([x for _, x in group]), strict=True):
                out[i].append(ids)

        for i, t in enumerate(texts):
            for x in segments(t.replace("\n", " ")):
                group.append((i, x))
                size += len(x)
                if size >= SEGMENT:
                    put()
                    group, size = [], 0
        if group:
            put()
        return [b"".join(x) for x in out]

    def _by_text(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.fast.encode_ordinary(t)).tobytes() for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.fast is None:
            return self._library(texts)
        if held := [i for i, t in enumerate(texts) if any(x in t for x in self.added)]:
            rest = set(range(len(texts))).difference(held)
            out = dict(zip(held, self._library([texts[i] for i in held]), strict=True))
            out |= dict(zip(sorted(rest), self.encode([texts[i] for i in sorted(rest)]), strict=True))
            return [out[i] for i in range(len(texts))]
        out = (self._by_words if self.suffix else self._by_text)(texts)
        if self.tried < TRIED:
            self.tried += len(texts)
            if self._library(texts[:TRIED]) != out[:TRIED]:
                self.fast = None
                return self._library(texts)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and vocabulary, with the ids of the library as it comes."""
    return Encoder(path, added=True)
