"""Whole-text encoding with the tokenizers library, each distinct word once per worker."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and strings between blanks, whose ids one worker holds at most. Only speed depends on it.
CACHE_WORDS = 300_000
#: Characters of the texts that are put together at a time: each distinct string among them is looked up once.
HELD_CHARACTERS = 10_000_000
#: The words of a byte-level tokenizer: contractions, letters, digits, other marks (with one blank before), blanks.
BYTE_LEVEL = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def steady_characters() -> str:
    """A character class: those of the basic plane on which the library's word classes and re's agree, assigned since
    Unicode 3.2 so that no version of the tables differs."""
    import regex

    every = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and unicodedata.ucd_3_2_0.category(chr(i)) != "Cn")
    differ: set[str] = set()
    differ |= set(re.findall(r"[^\W\d_]", every)) ^ set(regex.findall(r"\p{L}", every))
    differ |= set(re.findall(r"\d", every)) ^ set(regex.findall(r"\p{N}", every))
    differ |= set(re.findall(r"\s", every)) ^ set(regex.findall(r"\p{White_Space}", every))
    kept = sorted(ord(x) for x in every if x not in differ)
    ranges: list[list[int]] = []
    for x in kept:
        if ranges and ranges[-1][1] == x - 1:
            ranges[-1][1] = x
        else:
            ranges.append([x, x])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "]*"


class Encoder:
    """Ids of texts, the same as tokenizer.encode_batch(texts, add_special_tokens=False). What spells a special token in a
    text is text like any other, or with `special_strings` that token, as the library has it unless told otherwise."""

    def __init__(self, path: str, special_strings: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_strings
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", False)
            and not pre.get("add_prefix_space", True)
            and all(x["special"] for x in spec.get("added_tokens") or ())
        )
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        assert sys.byteorder == "little"
        # In a byte-level vocabulary a token has one character for each byte it stands for.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self.added = [x["content"] for x in spec.get("added_tokens") or ()] if special_strings else []
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.doubled = re.compile(r"\s\s").search
        self.split = re.compile(BYTE_LEVEL).findall
        self.steady = re.compile(steady_characters()).fullmatch if self.by_word else None

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        collects = gc.isenabled()
        gc.disable()  # millions of short-lived strings, no cycles among them
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        rest, held, size = [], [], 0
        for i, text in enumerate(texts):
            if not (self.by_word and self.steady(text)) or any(x in text for x in self.added):
                rest.append(i)
            elif self.doubled(text):
                out[i] = b"".join(self._words(self.split(text)))
            else:
                held.append(i)
                size += len(text)
                if size > HELD_CHARACTERS:
                    self._settle(held, texts, out)
                    held, size = [], 0
        self._settle(held, texts, out)
        for i, ids in zip(rest, self._bytes([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        if new := [w for w in dict.fromkeys(words) if w not in self.words]:
            if len(self.words) > CACHE_WORDS // 2:
                self.words.clear()
                new = list(dict.fromkeys(words))
            self.words.update(zip(new, self._bytes(new), strict=True))
        return [self.words[w] for w in words]

    def _settle(self, held: list[int], texts: list[str], out) -> None:
        """Texts without doubled white space: no word spans a blank but at its start, so what stands between blanks is
        encoded by itself, each distinct string once, and put together by position."""
        if not held:
            return
        lists = pc.split_pattern(pa.array([texts[i] for i in held], pa.string()), " ")
        bounds = lists.offsets.to_numpy()
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        index = coded.indices.to_numpy().copy()
        names = coded.dictionary.to_pylist()
        # A text's first string has no blank before it: it gets an entry of its own.
        firsts = [self.split(x) for x in flat.take(pa.array(bounds[:-1])).to_pylist()]
        words = iter(self._words([w for x in firsts for w in x]))
        heads = [b"".join([next(words) for _ in x]) for x in firsts]
        index[bounds[:-1]] = len(names) + np.arange(len(heads), dtype=index.dtype)
        ids = [*self._pieces(names), *heads]
        width = self.dtype.itemsize
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        starts = np.cumsum(lengths) - lengths
        every = np.frombuffer(b"".join(ids), self.dtype)
        n = lengths[index]
        stops = np.cumsum(n)
        at = np.repeat(starts[index] - (stops - n), n) + np.arange(stops[-1])
        tokens = every[at].tobytes()
        ends = [0, *(stops[bounds[1:] - 1] * width).tolist()]
        for k, i in enumerate(held):
            out[i] = tokens[ends[k] : ends[k + 1]]

    def _plain(self, words: list[str]) -> list[bytes]:
        """The ids of a blank and each of these words of letters. Many go through the library as one text; as its ids
        stand for known numbers of bytes, they fall apart again at the words' ends."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            texts = [" " + " ".join(part[k : k + 500]) for k in range(0, len(part), 500)]
            every = np.concatenate([np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum([len(w.encode("utf-8")) + 1 for w in part])
            at = np.searchsorted(np.cumsum(self.sizes[every]), ends) + 1
            data = every.tobytes()
            stops = (at * width).tolist()
            out += [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    def _pieces(self, names: list[str]) -> list[bytes]:
        """The ids of a blank and each of these distinct strings."""
        found = list(map(self.pieces.get, names))
        missing = [k for k, x in enumerate(found) if x is None]
        # Letters alone are one word, as are those before a last other character; what is left is cut into words.
        plain, tailed, mixed = {}, [], []
        for k in missing:
            name = names[k]
            if name.isalpha():
                plain[name] = None
            elif name[:-1].isalpha():
                tailed.append(k)
            else:
                mixed.append(k)
        known = {}
        for word in {names[k][:-1] for k in tailed}:
            if (x := self.pieces.get(word)) is not None:
                known[word] = x
            else:
                plain[word] = None
        plain = dict(zip(plain, self._plain(list(plain)), strict=True))
        known |= plain
        tails = [names[k][-1] for k in tailed]
        cuts = [self.split(" " + names[k]) for k in mixed]
        words = iter(self._words([*tails, *(w for x in cuts for w in x)]))
        for k in tailed:
            found[k] = known[names[k][:-1]] + next(words)
        for k, x in zip(mixed, cuts, strict=True):
            found[k] = b"".join([next(words) for _ in x])
        for k in missing:
            if found[k] is None:
                found[k] = plain[names[k]]
        if len(self.pieces) + len(missing) > CACHE_WORDS:
            self.pieces = dict(zip(names, found, strict=True))  # what is in use now
        else:
            self.pieces.update(zip([names[k] for k in missing], [found[k] for k in missing], strict=True))
        return found


class Cache:
    """Ids by string. Over its limit it keeps what the last call asked for and already knew: what is in use."""

    def __init__(self, limit: int):
        self.limit, self.ids, self.again = limit, {}, set()

    def missing(self, asked: set[str]) -> list[str]:
        new = asked.difference(self.ids)
        self.again = asked - new
        return list(new)

    def add(self, names: list[str], ids: list[bytes]) -> None:
        self.ids.update(zip(names, ids, strict=True))

    def shrink(self) -> None:
        if len(self.ids) > self.limit:
            self.ids, self.again = {x: self.ids[x] for x in self.again}, set()


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_strings: bool = False) -> Encoder:
    """One per worker, file and treatment of special strings."""
    key = (path, special_strings)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_strings)
    return _encoders[key]
