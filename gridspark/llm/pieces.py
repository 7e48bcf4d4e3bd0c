"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``Machine.load`` compiles a model file into three transducers: the normaliser (white space to its mark, a mark before the
text, the model's character map), the pieces (each input string to an id, at a cost), and byte fallback (a character that
no piece covers to its bytes' ids). ``encode`` composes them with one input lazily and takes the shortest path in the
tropical semiring (costs add along a path, the least path wins).

For unigram models a piece costs minus its score. For merge models, whose result is not a cheapest cover, the pieces are
composed with one more machine: an acceptor over pairs of neighbours that gives a pair cost 0 if merging the two pieces'
text yields just these two, and infinity otherwise. A cover all of whose neighbours are accepted is the one that merging
yields: a first merge across one of its borders would also occur when the two neighbours are merged alone. So exactly one
path of finite cost enters each place of the input, and the shortest path is the merge result.

Where two neighbouring characters stand together in no piece, every path enters the place between them, and merging
never crosses it: the composition falls apart there. What lies between two such places, mostly a word or its marks, is
memoised. Texts of unigram models are cut at words only, where white space marks start pieces and never follow other
characters within one (checked on loading).

Rows: a null text has no ids and decodes to an empty text. An empty text has no ids. Any text round-trips if the
model's normaliser is the identity; a text that starts with the white space mark itself decodes to a blank there.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.llm.common import c, lean
from gridspark.llm.tokenize import Cache

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Words one worker memoises at most, and pairs of pieces. Only speed and memory depend on them.
CACHE_WORDS = 150_000
CACHE_PAIRS = 300_000
#: Texts that a worker holds at a time, and characters of those whose words are looked up together.
SLICE = 1_000
TOGETHER = 500_000
#: Characters told apart when texts are cut; in a model with more of them some share a number, and cuts are fewer.
ALPHABET = 1 << 10
#: What an unknown character costs below the least score of a unigram model.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """(number, value) of a message's fields: varints as int, strings and messages as bytes, fixed 32 bits as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Machine:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.names = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.kind, self.dummy_prefix, self.squeeze = kind, dummy_prefix, squeeze
        self.escape = escape
        self.score = {p: s for p, s, k in pieces if k in (NORMAL, USER)}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.id), default=1)
        least = min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        self.unknown_cost = UNKNOWN_PENALTY - least
        # For the last characters of a place: the lengths of pieces that end so, longest first.
        ends: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.plain = [n.replace(MARK, " ") if escape else n for n in self.names]
        self.special = {i for i, k in enumerate(self.kinds) if k in (BYTE, UNKNOWN, CONTROL)}
        for b, i in self.byte.items():
            if b < 128:  # a character by itself, whatever bytes stand beside it
                self.plain[i] = chr(b)
                self.special.discard(i)
        self.cache = Cache(CACHE_WORDS)
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.id)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        inside = sorted({x for p in self.id if len(p) > 1 for x in p})
        number = {x: 1 + i % (ALPHABET - 1) for i, x in enumerate(inside)}
        self.number = np.zeros(ord(inside[-1]) + 2 if inside else 1, np.int32)  # the last for all characters beyond
        self.number[[ord(x) for x in inside]] = list(number.values())
        self.joins = np.zeros(ALPHABET * ALPHABET, bool)
        self.joins[[number[a] * ALPHABET + number[b] for p in self.id for a, b in zip(p, p[1:], strict=False)]] = True
        self.simple = self.by_word and escape and dummy_prefix and not squeeze

    @classmethod
    def load(cls, path: str) -> Machine:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, norm = [], UNIGRAM, {}
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                pieces.append((x[1].decode("utf-8"), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif number == 2:
                kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(fields(value))
        if kind not in (UNIGRAM, MERGES):
            raise NotImplementedError(f"model type {kind}")
        if norm.get(2):
            raise NotImplementedError("a model with a compiled character map; only the identity normaliser is built in")
        return cls(pieces, kind, bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1)))

    def forget(self) -> None:
        """Drops what is memoised: a worker that is used again by other stages should not hold it."""
        self.words, self.pairs, self.cache = {}, {}, Cache(CACHE_WORDS)

    # The normaliser.
    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text

    # Pieces composed with the pair acceptor.
    def merged(self, text: str) -> list[str]:
        """Merges of highest score first, left-most first among equals: what defines the pair acceptor."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def accepts(self, left: str, right: str) -> bool:
        """Whether the pair costs 0; left "" asks for the piece alone."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def shortest(self, text: str) -> list[str]:
        """Pieces and unknown characters along the shortest path."""
        return self._merge_path(text) if self.kind == MERGES else self._cheapest_path(text)

    def _merge_path(self, text: str) -> list[str]:
        return self._merge_paths([text])[0]

    def _merge_paths(self, texts: list[str]) -> list[list[str]]:
        """Shortest paths of many texts. What enters a place depends on the text up to there alone, so a text goes on
        from where it parts with the one before: in sorted order the composed machine's states are made once each."""
        accepts, ends, pairs, pieces = self.accepts, self.ends, self.pairs, self.id
        into: list[str] = [""]  # the one piece of finite cost that enters each place
        last, found = "", []
        for text in texts:
            n = len(text)
            same, most = 0, min(n, len(last))
            while same < most and text[same] == last[same]:
                same += 1
            del into[same + 1 :]
            for j in range(same + 1, n + 1):
                # Pieces that can end here: by their last three characters, then those of two and of one, known or not.
                for k in ends.get(text[j - 3 : j], ()) if j > 2 else ():
                    if k <= j:
                        s = text[j - k : j]
                        if s in pieces:
                            left = into[j - k]
                            ok = pairs.get((left, s))
                            if ok is None:
                                ok = (not left or accepts("", s)) and accepts(left, s)
                            if ok:
                                break
                else:
                    for k in (2, 1):
                        s = text[j - k : j] if k <= j else ""
                        if s and (k == 1 or s in pieces):
                            left = into[j - k]
                            ok = pairs.get((left, s))
                            if ok is None:
                                ok = (not left or accepts("", s)) and accepts(left, s)
                            if ok:
                                break
                    else:
                        raise AssertionError(f"no path into place {j}")
                into.append(s)
            out, j = [], n
            while j:
                s = into[j]
                out.append(s)
                j -= len(s)
            out.reverse()
            found.append(out)
            last = text
        return found

    def _cheapest_path(self, text: str) -> list[str]:
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        into = [""] * (n + 1)
        for i in range(n):
            here = cost[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                s = text[i:j]
                w = self.score.get(s)
                if w is not None:
                    w = here - w
                elif j == i + 1:
                    w = here + self.unknown_cost
                else:
                    continue
                if w < cost[j]:
                    cost[j], into[j] = w, s
        out, j = [], n
        while j:
            out.append(into[j])
            j -= len(into[j])
        out.reverse()
        return out

    # Byte fallback, and ids.
    def ids_of(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        if self.byte:
            return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def _word(self, word: str) -> bytes:
        return array("I", [i for p in self.shortest(word) for i in self.ids_of(p)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers of the machine's byte order."""
        text = self.normalise(text)
        if not text:
            return b""
        if not (self.by_word and self.escape):
            return self._word(text)
        first, *rest = text.split(MARK)
        out = [self._memo(first)] if first else []
        memo, blanks = self._memo, MARK
        for x in rest:  # marks that no character follows go with the next word
            if x:
                out.append(memo(blanks + x))
                blanks = MARK
            else:
                blanks += MARK
        if len(blanks) > 1:
            out.append(memo(blanks[1:]))
        return b"".join(out)

    def units(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Normalised texts cut wherever two neighbours stand together in no piece, and where each text's units begin."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[np.minimum(codes, len(self.number) - 1)]
        first = np.ones(len(codes), bool)
        first[1:] = ~self.joins[number[:-1] * ALPHABET + number[1:]]
        starts = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        first[starts[starts < len(codes)]] = True
        at = np.flatnonzero(first)
        begin = at.tolist()
        return [joined[a:b] for a, b in zip(begin, [*begin[1:], len(joined)], strict=True)] if begin else [], np.searchsorted(at, starts).tolist()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """encode() of each text; units of many texts, or words between single blanks, are looked up together."""
        out: list[bytes] = [b""] * len(texts)
        if self.kind == MERGES:
            lo = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > TOGETHER or i + 1 == len(texts):
                    out[lo : i + 1] = self._merge_many([self.normalise(x) for x in texts[lo : i + 1]])
                    lo, size = i + 1, 0
            return out
        held, size = [], 0
        for i, t in enumerate(texts):
            if self.simple and t and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t:
                held.append((i, t.split(" ")))
                size += len(t)
                if size > TOGETHER:
                    self._settle(held, out)
                    held, size = [], 0
            else:
                out[i] = self.encode(t)
        self._settle(held, out)
        return out

    def _merge_many(self, texts: list[str]) -> list[bytes]:
        units, begin = self.units(texts)
        fresh = self.cache.missing(set(units))
        fresh.sort()
        get = self.id.get
        ids = []
        for path in self._merge_paths(fresh):
            known = [get(p, -1) for p in path]
            ids.append(array("I", known if -1 not in known else [i for p in path for i in self.ids_of(p)]).tobytes())
        self.cache.add(fresh, ids)
        found = list(map(self.cache.ids.__getitem__, units))
        self.cache.shrink()
        return [b"".join(found[a:b]) for a, b in zip(begin, begin[1:], strict=False)]

    def _settle(self, held, out) -> None:
        fresh = self.cache.missing(set().union(*(words for _, words in held)))
        self.cache.add(fresh, [self._word(MARK + x) for x in fresh])
        get = self.cache.ids.__getitem__
        for i, words in held:
            out[i] = b"".join(map(get, words))
        self.cache.shrink()

    def _memo(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self._word(word)
            if len(self.words) >= CACHE_WORDS:
                self.words = {}
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def decode(self, ids) -> str:
        """The text of ids: the inverse transducers, byte runs as UTF-8 (what is not valid is replaced)."""
        plain = self.plain
        if self.special.isdisjoint(ids):
            text = "".join([plain[i] for i in ids])
            return text[1:] if self.dummy_prefix and text.startswith(" ") else text
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE and i in self.special:
                run.append(int(self.names[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if self.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kinds[i] != CONTROL:
                out.append(plain[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """One per worker and file."""
    if path not in _machines:
        _machines[path] = Machine.load(path)
    return _machines[path]


def encode_texts(df: DataFrame, text: str, model: str, keep: dict[str, Column], decode: bool = True) -> DataFrame:
    """Columns `keep`, ids (array of int), n_tokens, n_bytes_fallback, ids_crc32 (of the ids as little-endian 32-bit
    integers), and with `decode` round_trip: whether decoding the ids gives the text back."""
    rows = df.select(*[v.alias(k) for k, v in keep.items()], c(text).cast("string").alias("__text"))
    out = StructType(list(rows.drop("__text").schema.fields))
    for name, kind in (("ids", "array<int>"), ("n_tokens", "long"), ("n_bytes_fallback", "long"), ("ids_crc32", "long"), ("round_trip", "boolean")):
        out = out.add(name, StructType.fromDDL(f"x {kind}")[0].dataType)
    names = out.fieldNames()

    def run(batches):
        m = machine(model)
        m.forget()  # what an earlier task has left
        low, high = (min(m.byte.values()), max(m.byte.values())) if m.byte else (1, 0)
        for batch in batches:
            at = batch.num_columns - 1
            for lo in range(0, batch.num_rows, SLICE):
                part = [x or "" for x in batch.column(at).slice(lo, SLICE).to_pylist()]
                ids = [np.frombuffer(x, np.uint32) for x in m.encode_many(part)]
                n = [len(x) for x in ids]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))
                trip = [m.decode(i.tolist()) == x for i, x in zip(ids, part, strict=True)] if decode else [None] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(col.slice(lo, len(part)) for col in batch.columns[:at]),
                        lists,
                        pa.array(n, pa.int64()),
                        pa.array([int(((i >= low) & (i <= high)).sum()) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                        pa.array(trip, pa.bool_()),
                    ],
                    names=names,
                )
        m.forget()

    return rows.mapInArrow(lean(run), out)


def decode_ids(df: DataFrame, ids: str, model: str, keep: dict[str, Column]) -> DataFrame:
    """Columns `keep` and text, decoded from an array of ids; null ids give an empty text."""
    rows = df.select(*[v.alias(k) for k, v in keep.items()], c(ids).alias("__ids"))
    out = StructType(list(rows.drop("__ids").schema.fields)).add("text", "string")

    def run(batches):
        m = machine(model)
        for batch in batches:
            at = batch.num_columns - 1
            texts = [m.decode(x or ()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=out.fieldNames())

    return rows.mapInArrow(run, out)
