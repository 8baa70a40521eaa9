"""Encoding whole texts with public tokenizer files, word by word through a bounded cache.

The library encodes every distinct word; a text's ids are its words' ids in
order.  Cuts are made only where the tokenizer's own pre-tokenizer must cut, so
the ids equal those of one call on the whole text.  A tokenizer whose
pre-tokenizer isn't known here, or a text that holds one of its special
strings, is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

#: White space as the tokenizer library's regular expressions have it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Two such characters in a row, or one that is neither a space nor a line feed.
_ODD = re.compile(f"[{SPACE}][{SPACE}]|[{SPACE[6:]}\\t\\x0b-\\r]")
#: The word-end tokenizer's normaliser and pre-tokenizer: white space separates and is dropped.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


#: A plain word: letters that no normaliser composes or reorders, then ASCII marks other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Generations:
    """A map from segments to ids in two generations: a full young one becomes the old one.

    Frequent segments are promoted again before the old generation goes, so
    memory is bounded by twice ``size`` entries and common words stay.
    """

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def take(self, keys: list[str], make) -> list[bytes]:
        young = self.young
        try:
            return [young[k] for k in keys]
        except KeyError:
            pass
        if len(young) > self.size:
            self.old, self.young = young, {}
            young = self.young
        old = self.old
        missing = []
        for k in {k for k in keys if k not in young}:
            if k in old:
                young[k] = old[k]
            else:
                missing.append(k)
        for k, v in zip(missing, make(missing)):
            young[k] = v
        return [young[k] for k in keys]


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Encodes texts with one tokenizer file; ``cache_words`` bounds its memory."""

    def __init__(self, path: str, cache_words: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words, self.bare, self.cores = Generations(cache_words), Generations(cache_words // 8), Generations(cache_words // 2)
        self.word_counts, self.bare_counts = Generations(cache_words), Generations(cache_words // 8)
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.mode, self.special = "whole", re.compile("(?!)")
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in rule["added_tokens"]) or "(?!)")
        pre, norm = rule["pre_tokenizer"] or {}, rule["normalizer"] or {}
        parts = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm and not rule["post_processor"]:
            self.mode = "spaced"
        elif parts and parts[0].get("pattern", {}).get("Regex") == _WORD_PATTERN and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.mode = "words"
        else:
            self.mode = "whole"

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of whole texts, without a cache."""
        if not texts:
            return []
        if self.pieces is not None:
            return self.pieces.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return [b"".join(self._parts(t)) for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        """The number of ids of each text; caches numbers, not ids."""
        out = []
        for text in texts:
            bare, rest = self._cut(text)
            if bare is None:
                out.append(len(self.whole([text])[0]))
                continue
            n = sum(self.bare_counts.take(bare, self._new_counts)) if bare else 0
            if rest:
                n += sum(self.word_counts.take(rest, lambda w: self._new_counts(self._spaced(w))))
            out.append(n)
        return out

    def _new_counts(self, segments: list[str]) -> list[int]:
        return [len(b) // 4 for b in self._new(segments)]

    def _parts(self, text: str) -> list[bytes]:
        bare, rest = self._cut(text)
        if bare is None:
            return [pack(ids) for ids in self.whole([text])]
        out = self.bare.take(bare, self._new) if bare else []
        return out + self.words.take(rest, lambda w: self._new(self._spaced(w))) if rest else out

    def _cut(self, text: str) -> tuple[list[str] | None, list[str]]:
        """Segments as they stand, and those that :meth:`_spaced` completes; None if the text must stay whole."""
        if self.mode == "whole" or self.special.search(text):
            return None, []
        if self.mode == "words":
            low = text.lower()
            # Lower-casing first must not change what composition does, nor meet the letter whose case depends on its place.
            if "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low):
                text = low
            return [], text.replace("\n", " ").split(" ")
        if _ODD.search(text):
            return _SEGMENT.findall(text), []
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first], rest

    def _spaced(self, words: list[str]) -> list[str]:
        """In byte-level texts a word is preceded by a space, unless it begins a line."""
        return words if self.mode == "words" else [w if w[:1] == "\n" else " " + w for w in words]

    def _new(self, segments: list[str]) -> list[bytes]:
        """Ids of segments that no cache holds: plain words by their parts, others by the library whole."""
        plain: list[tuple[str, str, str] | None] = []
        for s in segments:
            line = self.mode == "spaced" and s[:1] == "\n"
            lead = self.mode == "spaced" and s[:1] == " "
            m = _PLAIN.fullmatch(s, int(lead or line))
            plain.append(("\n" * line, s[int(line) : m.end(1)], m[2]) if m and (m[1] or line) else None)
        rest = iter(self.whole([s for s, p in zip(segments, plain) if p is None]))
        found = iter(self.cores.take([x for p in plain if p for x in p], self._model))
        return [next(found) + next(found) + next(found) if p else pack(next(rest)) for p in plain]

    def _model(self, pieces: list[str]) -> list[bytes]:
        tokenize, out = self.library.model.tokenize, []
        for s in pieces:
            if self.mode == "words":
                s = s.lower()
            if not (s.isascii() and s.isprintable()) or " " in s:
                s = s.encode().decode("latin-1").translate(_LETTERS)
            out.append(pack([t.id for t in tokenize(s)]) if s else b"")
        return out


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = 200_000) -> Encoder:
    """One encoder a worker process and file; Python workers are reused across tasks."""
    return Encoder(path, cache_words)


@lru_cache(maxsize=8)
def version_digest(path: str) -> str:
    """SHA-256 of the tokenizer file, which names its version."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
