"""SentencePiece BPE encoding with byte offsets, and decoding, from a model file's bytes.

The normaliser walks the compiled character map (a double-array trie) for the longest prefix and records, for each normalised byte,
the offset of its source byte. Pieces are found in the normalised text and projected through that alignment to spans of the original.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixkin.llm.common import small_batches

SPACE = "▁"
MARK = SPACE.encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
#: Segmented words that a worker remembers; the memory starts anew beyond.
MEMORY = 200_000


def fields(buf: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer: bytes, or int for varints, or four raw bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, i = buf[i : i + n], i + n
        yield tag >> 3, value


class CharMap:
    """Longest-prefix lookups in a compiled character map: size of the trie, the trie's units, NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        self.starts = frozenset(b for b in range(256) if self.step(self.root(), b) is not None) if self.units else frozenset()
        #: Runs of ASCII bytes of which none begins a key are copied as they are.
        plain = bytes(b for b in range(128) if b not in self.starts)
        self.plain = re.compile(b"[" + re.escape(plain) + b"]+") if plain else re.compile(b"(?!)")

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def root(self) -> int:
        return self.offset(self.units[0])

    def step(self, at: int, byte: int) -> tuple[int, int | None] | None:
        """The place after a byte and, if a key ends there, its value."""
        at ^= byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        unit = self.units[at]
        at ^= self.offset(unit)
        return at, self.units[at] & 0x7FFFFFFF if unit & 256 else None

    def longest(self, data: bytes, i: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key at ``i`` and the key's length."""
        if data[i] not in self.starts:
            return None
        at, best, j = self.root(), None, i
        while j < len(data) and (found := self.step(at, data[j])):
            at, value = found
            j += 1
            if value is not None:
                best = value, j - i
        return best and (self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1])


def char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Pairs:
    """What two pieces merge to, by open addressing: ranks (0: the best score) and ids, for whole arrays of pairs."""

    NONE = 2**31 - 1

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        found = [(ids[p[:i]] << 32 | ids[p[i:]], order[scores[p]], k) for p, k in ids.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        self.bits = max(4, (8 * len(found)).bit_length())
        self.keys, self.ranks, self.ids = np.full(2**self.bits, -1, np.int64), np.full(2**self.bits, self.NONE, np.int32), np.zeros(2**self.bits, np.int32)
        todo = np.array(found, np.int64).reshape(-1, 3)
        at = self.place(todo[:, 0])
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.ranks[at[put]], self.ids[at[put]] = todo[put].T
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & (2**self.bits - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = a.astype(np.int64) << 32 | b
        at = self.place(keys)
        there = self.keys[at]
        while len(miss := np.flatnonzero((there != keys) & (there >= 0))):
            at[miss] = (at[miss] + 1) & (2**self.bits - 1)
            there[miss] = self.keys[at[miss]]
        return np.where(there == keys, self.ranks[at], self.NONE), self.ids[at]


class Words(dict):
    """What words were segmented into, until there are too many."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= 32:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = out
        return out


class Model:
    def __init__(self, data: bytes):
        self.pieces, self.types, scores = [], [], []
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape, self.suffix = CharMap(b""), True, True, True, False
        self.byte_fallback, self.unk, self.bos, self.eos, self.unk_surface, kind = False, 0, 1, 2, " ⁇ ", 1
        for k, v in fields(data):
            if k == 1:
                piece = dict(fields(v))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif k == 2:
                spec = dict(fields(v))
                kind, self.byte_fallback, self.suffix = spec.get(3, 1), bool(spec.get(35, 0)), bool(spec.get(24, 0))
                signed = lambda x: x - 2**64 if x >= 2**63 else x
                self.unk, self.bos, self.eos = (signed(spec.get(f, d)) for f, d in ((40, 0), (41, 1), (42, 2)))
                self.unk_surface = spec[44].decode() if 44 in spec else self.unk_surface
            elif k == 3:
                spec = dict(fields(v))
                self.charsmap = CharMap(spec.get(2, b""))
                self.dummy_prefix, self.squeeze, self.escape = (bool(spec.get(f, 1)) for f in (3, 4, 5))
        if kind != 2 or USER in self.types or self.suffix or not self.escape:
            raise ValueError("only BPE models that mark spaces in front and have no user-defined pieces are supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, UNUSED)}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.unused = {p for p, i in self.ids.items() if self.types[i] == UNUSED}
        self.bytes_ = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        # No piece goes on past a space mark: then words can be segmented apart.
        self.apart = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) else "(?s:.+)")
        special = {CONTROL: "", UNKNOWN: self.unk_surface}
        self.surfaces = [bytes([int(p[3:5], 16)]) if t == BYTE else special.get(t, p.replace(SPACE, " ")).encode() for p, t in zip(self.pieces, self.types)]
        self.is_byte = np.array([t == BYTE for t in self.types])
        self.known = {p: (i, len(p.encode())) for p, i in self.ids.items() if p not in self.unused}
        self.words = Words(self.segment)
        self.sizes = np.array([len(p.encode()) for p in self.pieces], np.int64)
        used = {c for p in self.ids for c in p}
        self.chars = None  # by code point, if every character that a piece has is a piece itself
        if used <= self.ids.keys() and not self.unused:
            self.chars = np.full(0x110000, -1, np.int32)
            for c in used:
                self.chars[ord(c)] = self.ids[c]
            self.pairs = Pairs(self.ids, self.scores)
        self.all_known = re.compile("[" + re.escape("".join(sorted(used))) + "]+")

    # -- normalising ---------------------------------------------------------------------------------------------------

    def normalize(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and the source offset of each, and of the end."""
        if not data:
            return b"", np.zeros(1, np.int32)
        if not self.charsmap.units and not self.squeeze:
            return self.mark_spaces(data)
        out, align, i, n = bytearray(), [], 0, len(data)

        def prefix(i: int) -> tuple[bytes, int]:
            found = self.charsmap.longest(data, i) if self.charsmap.units else None
            size = char_length(data[i])
            return found or (data[i : i + size], size)

        def put(text: bytes, at: int) -> None:
            text = text.replace(b" ", MARK)
            out.extend(text)
            align.extend([at] * len(text))

        if self.squeeze:
            while i < n and prefix(i)[0] == b" ":
                i += prefix(i)[1]
            if i == n:
                return b"", np.zeros(1, np.int32)
        if self.dummy_prefix:
            put(b" ", i)
        spaced = self.squeeze
        while i < n:
            run = self.charsmap.plain.match(data, i)
            if run and b" " not in run[0]:
                out.extend(run[0])
                align.extend(range(i, run.end()))
                i, spaced = run.end(), False
                continue
            text, size = prefix(i)
            if spaced:
                text = text.lstrip(b" ")
            if text:
                put(text, i)
                spaced = text.endswith(b" ")
            i += size
            spaced = spaced and self.squeeze
        end = n
        if self.squeeze:
            while out.endswith(MARK):
                end = align[len(out) - 3]
                del out[-3:], align[-3:]
        return bytes(out), np.array([*align, end], np.int32)

    def mark_spaces(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The same for an empty map that keeps all spaces: only the space marks move offsets."""
        out = (MARK if self.dummy_prefix else b"") + data.replace(b" ", MARK)
        width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        ends = np.cumsum(width, dtype=np.int64) + 3 * self.dummy_prefix
        align = np.zeros(len(out) + 1, np.int32)  # set at boundaries of source bytes, the only places that pieces end
        align[ends] = np.arange(1, len(data) + 1)
        return out, align

    # -- segmenting ----------------------------------------------------------------------------------------------------

    def merge(self, word: str) -> list[str]:
        """Byte-pair merges by the best score, ties leftmost."""
        parts, score = list(word), self.scores.get
        if len(parts) > 48:
            return self.merge_long(parts)
        none = -1e30
        pairs = [score(a + b, none) for a, b in zip(word, word[1:])]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            both = parts[i] + parts.pop(i + 1)
            parts[i] = both
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(both + parts[i + 1], none)
            if i:
                pairs[i - 1] = score(parts[i - 1] + both, none)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        n, score = len(parts), self.scores.get
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(parts[i]), len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if len(parts[i]) != a or len(parts[j]) != b or right[i] != j:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def split_unused(self, piece: str) -> list[str]:
        """Unused pieces fall apart into what they were merged from: here, by merging again without them."""
        if piece not in self.unused or len(piece) == 1:
            return [piece]
        held = {p: self.scores.pop(p) for p in list(self.scores) if p in self.unused}
        try:
            return self.merge(piece)
        finally:
            self.scores.update(held)

    def segment(self, word: str) -> bytes:
        """Pairs of 32-bit numbers, id and normalised bytes, of a word's pieces. Of the byte pieces of a character, the last has its bytes."""
        out, get = array("I"), self.known.get
        for piece in self.merge(word):
            if pair := get(piece):
                out.extend(pair)
                continue
            for p in self.split_unused(piece):
                raw = p.encode()
                if (i := self.ids.get(p)) is not None:
                    out.extend((i, len(raw)))
                elif self.byte_fallback:
                    for b in raw[:-1]:
                        out.extend((self.bytes_[b], 0))
                    out.extend((self.bytes_[raw[-1]], len(raw)))
                elif out and out[-2] == self.unk:
                    out[-1] += len(raw)
                else:
                    out.extend((self.unk, len(raw)))
        return out.tobytes()

    def segment_all(self, words: list[str]) -> list[bytes]:
        """segment() of short words of known characters, merging in all words at once: each round does every word's best merge."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        tok = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word, none = np.repeat(np.arange(n), sizes), Pairs.NONE
        done_tok, done_word = [], []

        def ranked(at: np.ndarray) -> None:
            inside = word[at] == word[np.minimum(at + 1, len(word) - 1)]
            inside &= at + 1 < len(word)
            rank[at] = none
            at = at[inside]
            rank[at], into[at] = self.pairs.find(tok[at], tok[at + 1])

        rank, into = np.empty(len(tok), np.int32), np.zeros(len(tok), np.int32)
        ranked(np.arange(len(tok)))
        while len(tok):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(tok))))
            live = best < none
            if not live.all():
                done_tok.append(tok[~live])
                done_word.append(word[~live])
                tok, word, rank, into, best = tok[live], word[live], rank[live], into[live], best[live]
                if not len(tok):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
            tok[hit] = into[hit]
            stay = np.ones(len(tok), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))  # places after the right halves are gone: one before each, by earlier words
            tok, word, rank, into = tok[stay], word[stay], rank[stay], into[stay]
            ranked(hit)
            ranked(hit[hit > 0] - 1)
        tok, word = np.concatenate(done_tok), np.concatenate(done_word)
        by_word = np.argsort(word, kind="stable")
        tok = tok[by_word]
        out = np.stack([tok, self.sizes[tok]], axis=1).astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(word, minlength=n)) * 8).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: set[str]) -> None:
        """Segment those words that aren't known yet together."""
        if self.chars is None:
            return
        plain = self.all_known.fullmatch
        new = [w for w in words.difference(self.words) if len(w) <= 32 and plain(w)]
        if len(self.words) + len(new) > MEMORY:
            self.words.clear()
            new = [w for w in words if len(w) <= 32 and plain(w)]
        if new:
            self.words.update(zip(new, self.segment_all(new)))

    def encode_all(self, texts: list[str], ends: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of many texts, whose new words are segmented at once."""
        whole = [(t.encode(), *self.normalize(t.encode())) for t in texts]
        split = [self.apart.findall(norm.decode()) for _, norm, _ in whole]
        self.learn(set(chain.from_iterable(split)))
        for (data, _, align), words in zip(whole, split):
            yield self.project(data, align, words, ends)

    def encode(self, text: str, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end of each piece in the UTF-8 bytes of the text; ``ends`` adds the begin and end ids."""
        data = text.encode()
        norm, align = self.normalize(data)
        return self.project(data, align, self.apart.findall(norm.decode()), ends)

    def project(self, data: bytes, align: np.ndarray, words: list[str], ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the words, projected through the alignment to spans of the source."""
        pairs = np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")
        ids, sizes = pairs[::2], pairs[1::2]
        stop = np.cumsum(sizes, dtype=np.int64)
        end, begin = align[stop], align[stop - sizes]
        if ends:
            n = len(data)
            ids = np.concatenate([np.array([self.bos], "<u4"), ids, np.array([self.eos], "<u4")])
            begin, end = (np.concatenate([np.zeros(1, np.int32), x, np.full(1, n, np.int32)]) for x in (begin, end))
        return ids, begin, end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces vanish, bytes that aren't UTF-8 become U+FFFD, the first piece loses the space put in front."""
        first = next((i for i in ids[:8].tolist() if self.types[i] != CONTROL), None)
        if first is None and len(ids) > 8:
            first = next((i for i in ids.tolist() if self.types[i] != CONTROL), None)
        listed = ids.tolist()
        if not self.is_byte[ids].any():
            out = b"".join(map(self.surfaces.__getitem__, listed)).decode()
        else:
            parts, run = [], bytearray()
            for i in listed:
                if self.types[i] == BYTE:
                    run += self.surfaces[i]
                else:
                    if run:
                        parts.append(strict_utf8(bytes(run)))
                        run = bytearray()
                    parts.append(self.surfaces[i].decode())
            out = "".join([*parts, strict_utf8(bytes(run))])
        marked = first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE)
        return out[1:] if marked and (self.dummy_prefix or self.squeeze) else out


def strict_utf8(data: bytes) -> str:
    """Each byte that begins no whole character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            size = char_length(data[i])
            try:
                out.append(data[i : i + size].decode())
                i += size
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of items of about ``most`` together."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


_models: dict[int, Model] = {}


def model_of(data: bytes) -> Model:
    """One model a worker, with the words it has met."""
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def encode_documents(docs: DataFrame, model_file: str, *, text: str = "text", doc_id: str = "doc_id", spans: bool = True, decode: bool = True, arrays: bool = False) -> DataFrame:
    """doc_id; ids, and with ``spans`` begins and ends, begin and end ids included; with ``decode``, decoded: the text of the ids.

    Numbers come packed as little-endian 32-bit binaries, or with ``arrays`` as arrays of int. A null text is an empty one (two ids).
    The model's bytes (its size is that of a vocabulary) travel with the function. Null or repeated doc_ids keep their rows.
    """
    with open(model_file, "rb") as f:
        data = f.read()
    numbers = ["ids", *(("begins", "ends") if spans else ())]
    kind = pa.list_(pa.int32()) if arrays else pa.binary()
    schema = pa.schema([("doc_id", pa.int64()), *((n, kind) for n in numbers), *((("decoded", pa.string()),) if decode else ())])

    def packed(columns: list[np.ndarray]) -> pa.Array:
        if not arrays:
            return pa.array([c.tobytes() for c in columns], kind)
        ends = np.cumsum([0, *map(len, columns)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for b in batches:
            keys, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for part in slices([len(t) for t in texts], 1_000_000):
                found = list(model.encode_all(texts[part]))
                columns = [keys[part], *(packed([f[i] for f in found]) for i in range(len(numbers)))]
                if decode:
                    columns.append(pa.array([model.decode(f[0]) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    made = "doc_id long" + "".join(f", {n} {'array<int>' if arrays else 'binary'}" for n in numbers) + (", decoded string" if decode else "")
    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, made)


def piece_report(docs: DataFrame, model_file: str) -> DataFrame:
    """The digest: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begins, then ends)."""
    e = encode_documents(docs, model_file)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return e.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))
