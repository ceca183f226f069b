"""SentencePiece BPE encoding with byte offsets into the original text, and decoding.

A text is normalised by the longest matching prefix in the model's compiled character map. Each normalised byte records which
original byte it comes from, so every piece projects back to a span of original bytes. Pieces are found by merging the best-scored
neighbours, the leftmost first on ties; characters without a piece fall back to byte pieces where the model has them.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalink.llm.common import text_bytes

SPACE = "▁"
WHOLE = r"[\s\S]+"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
SLICE = 256  # texts encoded at a time
CACHE_ENTRIES = 200_000  # remembered words per Python worker; saves time only, results do not depend on it


def _one_per_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("catalink-each", _one_per_byte)


@dataclass
class Model:
    """What the codec needs of a model file; plain data, so that it travels in a broadcast."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    charmap: bytes
    add_dummy_prefix: bool
    remove_extra_whitespaces: bool
    escape_whitespaces: bool
    byte_fallback: bool
    unk_surface: str

    @classmethod
    def load(cls, path: str) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that mark the beginning of words are supported")
        norm = proto.normalizer_spec
        return cls(
            [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces],
            norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces,
            proto.trainer_spec.byte_fallback, proto.trainer_spec.unk_surface,
        )


class CharacterMap:
    """Longest-prefix replacement through a double-array trie followed by its zero-terminated replacement texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", count=size // 4, offset=4).tolist()
        self.texts = blob[4 + size :]
        self.firsts = {b for b in range(256) if self.longest(bytes([b]), 0, True) is not None}

    def longest(self, text: bytes, start: int, touch: bool = False):
        """(replacement, bytes read) of the longest entry at ``start``, else None; ``touch``: whether any entry begins so."""
        units, found = self.units, None
        node = units[0]
        place = (node >> 10) << ((node & 0x200) >> 6)
        for at in range(start, len(text)):
            place ^= text[at]
            if place >= len(units):
                break
            node = units[place]
            if node & 0x800000FF != text[at]:
                break
            if touch:
                return b"", 0
            place ^= (node >> 10) << ((node & 0x200) >> 6)
            if node >> 8 & 1:
                value = units[place] & 0x7FFFFFFF
                found = self.texts[value : self.texts.index(0, value)], at + 1 - start
        return found


def _character_length(text: bytes, at: int) -> int:
    """Bytes of the character at ``at``; 0 where no valid one begins."""
    lead = text[at]
    length = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    try:
        text[at : at + length].decode()
    except UnicodeDecodeError:
        return 0
    return length if at + length <= len(text) else 0


class Merges:
    """The merges of many short words at once: symbols are numbers, a table has the rank and the result of each pair that merges."""

    WIDTHS = (8, 14, 22, 32, 48)

    def __init__(self, ids: dict[str, int], order: dict[str, int], none: int):
        self.none, self.base = none, max(ids.values()) + 1
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):  # in pieces, but no piece itself
            symbols[c] = self.base + ord(c)
        self.span = self.base + 0x110000
        found = [
            (symbols[p[:k]] * self.span + symbols[p[k:]], order[p], symbols[p])
            for p in ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        ]
        table = np.array(sorted(found) or [(-1, none, 0)], np.int64)
        self.keys, self.ranks, self.results = (np.ascontiguousarray(table[:, i]) for i in range(3))
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.base  # of a code point; one without a piece cannot merge further
        for c, i in ids.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        self.widths = np.zeros(self.base, np.int32)  # bytes in the original text, where a mark is a space
        for p, i in ids.items():
            self.widths[i] = len(p.encode()) - 2 * p.count(SPACE)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.span + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], self.none), self.results[place]

    def encode(self, words: list[str]) -> list[bytes | None]:
        """Packed pairs of id and width for each word; None for one that is too long or has a character without a piece."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.array(list(map(len, words)))
        floor = 0
        for width in self.WIDTHS:
            chosen = np.flatnonzero((sizes > floor) & (sizes <= width))
            floor = width
            if len(chosen):
                self._group([words[i] for i in chosen], sizes[chosen], width, chosen.tolist(), out)
        return out

    def _group(self, words: list[str], sizes: np.ndarray, width: int, places: list[int], out: list) -> None:
        n = len(words)
        column = np.arange(width)
        inside = column < sizes[:, None]
        grid = np.full((n, width + 1), -1, np.int64)
        grid[:, :width][inside] = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        ranks = np.full((n, width + 1), self.none, np.int64)
        results = np.zeros((n, width + 1), np.int64)
        paired = np.zeros((n, width + 1), bool)
        paired[:, : width - 1] = column[1:] < sizes[:, None]
        r, c = np.nonzero(paired)
        ranks[r, c], results[r, c] = self._pairs(grid[r, c], grid[r, c + 1])
        rows = np.arange(n)
        while len(rows):
            best = ranks[rows].argmin(1)  # the first of equals is the leftmost
            going = ranks[rows, best] < self.none
            rows, left = rows[going], best[going]
            if not len(rows):
                break
            right = after[rows, left]
            following = after[rows, right]
            grid[rows, left] = results[rows, left]
            grid[rows, right] = -1
            ranks[rows, right] = self.none
            after[rows, left] = following
            ranks[rows, left] = self.none
            more = following < sizes[rows]
            r, a, b = rows[more], left[more], following[more]
            before[r, b] = a
            ranks[r, a], results[r, a] = self._pairs(grid[r, a], grid[r, b])
            more = before[rows, left] >= 0
            r, b = rows[more], left[more]
            a = before[r, b]
            ranks[r, a], results[r, a] = self._pairs(grid[r, a], grid[r, b])
        known = (grid < self.base).all(1).tolist()
        alive = grid >= 0
        flat = grid[alive]
        pairs = np.stack([flat, self.widths[np.minimum(flat, self.base - 1)]], 1).astype("<i4").tobytes()
        ends = (8 * np.concatenate([[0], np.cumsum(alive.sum(1))])).tolist()
        for place, ok, start, end in zip(places, known, ends, ends[1:]):
            if ok:
                out[place] = pairs[start:end]


class Codec:
    def __init__(self, model: Model):
        self.model = model
        self.map = CharacterMap(model.charmap) if model.charmap else None
        self.mark = (SPACE if model.escape_whitespaces else " ").encode()
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, USER_DEFINED, UNUSED)}
        self.unknown = model.types.index(UNKNOWN)
        self.bytes = [0] * 256
        for i, (piece, kind) in enumerate(zip(model.pieces, model.types)):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
        self.unused = {i for i, t in enumerate(model.types) if t == UNUSED}
        steps = {x: i for i, x in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
        self.order, self.none = {p: steps[model.scores[i]] for p, i in self.ids.items()}, len(steps)
        own = sorted((p for p, t in zip(model.pieces, model.types) if t == USER_DEFINED), key=len, reverse=True)
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        inner = [p for p in self.ids if len(p) > 1]
        bridging = "".join(sorted({c for p in inner for c in p} - {SPACE}))
        if self.own or any(SPACE in p.lstrip(SPACE) for p in inner):
            self.chunks = re.compile(WHOLE)  # some piece crosses words: the whole text is one chunk
        else:
            # No piece crosses these borders, so that merges inside a chunk are those of the whole text.
            letters = f"[{re.escape(bridging)}]" if bridging else r"(?!)"
            self.chunks = re.compile(f"{SPACE}+{letters}*|{letters}+|[\\s\\S]")
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # Without a character map, and if no piece crosses words or lines, a word has the same pieces wherever it stands.
        self.plain = (
            self.map is None and not self.own and not self.unused and self.chunks.pattern != WHOLE and "\n" not in bridging
            and model.byte_fallback and model.add_dummy_prefix and model.escape_whitespaces and not model.remove_extra_whitespaces
        )
        if self.plain:
            self.merges = Merges(self.ids, self.order, self.none)
        surfaces = []
        for piece, kind in zip(model.pieces, model.types):
            if kind == BYTE:
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                surfaces.append(b"")
            else:
                surfaces.append((model.unk_surface if kind == UNKNOWN else piece.replace(SPACE, " ")).encode())
        self.surfaces = surfaces
        self.controls = {i for i, t in enumerate(model.types) if t == CONTROL}

    # ---- normalisation ---------------------------------------------------------------------------------------

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the original byte it begins at."""
        if self.map is None and not self.model.remove_extra_whitespaces and not self.own:
            return self._escape(text)
        return self._normalize_by_prefix(text)

    def _escape(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a model without a character map: only spaces change, and each invalid byte is replaced."""
        if not text:
            return b"", np.zeros(1, np.int64)
        try:
            text.decode()
        except UnicodeDecodeError:
            return self._normalize_by_prefix(text)
        prefix = self.mark if self.model.add_dummy_prefix else b""
        widths = np.ones(len(text) + 1, np.int64)
        widths[:-1][np.frombuffer(text, np.uint8) == 0x20] = len(self.mark)
        origin = np.concatenate([np.zeros(len(prefix), np.int64), np.repeat(np.arange(len(text) + 1), widths)])
        return prefix + text.replace(b" ", self.mark), origin

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        if self.own and (hit := self._own_at(text, at)):
            return hit, len(hit)
        if self.map and text[at] in self.map.firsts and (found := self.map.longest(text, at)):
            return found
        length = _character_length(text, at)
        return (text[at : at + length], length) if length else ("�".encode(), 1)

    def _own_at(self, text: bytes, at: int) -> bytes:
        if not hasattr(self, "own_bytes"):
            self.own_bytes = re.compile(self.own.pattern.encode())
        hit = self.own_bytes.match(text, at)
        return hit.group() if hit else b""

    def _normalize_by_prefix(self, text: bytes) -> tuple[bytes, np.ndarray]:
        squeeze, at = self.model.remove_extra_whitespaces, 0
        while squeeze and at < len(text):
            piece, length = self._prefix(text, at)
            if piece != b" ":
                break
            at += length
        if at >= len(text):
            return b"", np.zeros(1, np.int64)
        out, origin = bytearray(), []

        def put(part: bytes) -> None:
            out.extend(part)
            origin.extend([at] * len(part))

        if self.model.add_dummy_prefix:
            put(self.mark)
        after_space = squeeze
        while at < len(text):
            piece, length = self._prefix(text, at)
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            if piece:
                put(piece.replace(b" ", self.mark))
                after_space = piece.endswith(b" ") and squeeze
            at += length
        end = at
        while squeeze and out.endswith(self.mark):
            del out[-len(self.mark) :]
            end = origin[len(out)]
            del origin[len(out) :]
        return bytes(out), np.array([*origin, end], np.int64)

    # ---- pieces ----------------------------------------------------------------------------------------------

    def _merge_short(self, chunk: str) -> list[str]:
        """The merges of a short chunk: again and again the best neighbours, the leftmost first."""
        parts, order, none = list(chunk), self.order, self.none
        ranks = [order.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = order.get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = order.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge(self, chunk: str) -> list[str]:
        """The same with a heap, for any length, user-defined pieces (never merged) and unused ones (taken apart again)."""
        parts: list[str | None] = []
        frozen = set()
        at = 0
        while at < len(chunk):
            hit = self.own.match(chunk, at) if self.own else None
            if hit:
                frozen.add(len(parts))
            parts.append(hit.group() if hit else chunk[at])
            at += len(parts[-1])
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        ids, scores, heap, undo = self.ids, self.model.scores, [], {}

        def offer(left: int, right: int) -> None:
            if left < 0 or right < 0 or left in frozen or right in frozen:
                return
            both = parts[left] + parts[right]
            found = ids.get(both)
            if found is not None:
                heapq.heappush(heap, (-scores[found], left, right, len(both)))
                if found in self.unused:
                    undo[both] = parts[left], parts[right]

        for i in range(1, len(parts)):
            offer(i - 1, i)
        while heap:
            _, left, right, length = heapq.heappop(heap)
            if parts[left] is None or parts[right] is None or len(parts[left]) + len(parts[right]) != length:
                continue
            parts[left] += parts[right]
            parts[right] = None
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        whole = [p for p in parts if p is not None]
        if not undo:
            return whole
        done, stack = [], whole[::-1]
        while stack:
            part = stack.pop()
            if ids.get(part) in self.unused and part in undo:
                stack.extend(undo[part][::-1])
            else:
                done.append(part)
        return done

    def _word(self, word: str, marked: bool) -> bytes:
        """Pairs of id and width, packed: of a token of a plain text in original bytes, or of a normalised part."""
        out = []
        for chunk in self.chunks.findall(word) if marked else [word]:
            short = len(chunk) <= 48 and not self.own and not self.unused
            for part in self._merge_short(chunk) if short else self._merge(chunk):
                found = self.ids.get(part)
                raw = part.encode()
                width = len(raw) - 2 * (marked and part[0] == SPACE)
                if found is not None:
                    out += found, width
                elif self.model.byte_fallback:  # the last byte piece of a character has its whole span
                    out += [x for b in raw for x in (self.bytes[b], 0)]
                    out[-1] = width
                else:
                    out += self.unknown, width
        return struct.pack(f"<{len(out)}i", *out)

    def _learn(self, tokens: set[str]) -> None:
        """Look up tokens of plain texts that are not known yet; a line break's token has no space before it."""
        new = [t for t in tokens if t not in self.words]
        if len(self.words) + len(new) > CACHE_ENTRIES:
            self.words.clear()
            new = list(tokens)
        shown = [t if t[:1] == "\n" else SPACE + t for t in new]
        for token, word, packed in zip(new, shown, self.merges.encode(shown)):
            self.words[token] = self._word(word, True) if packed is None else packed

    def encode_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of each text; the new words of all are looked up together."""
        split = [self._plain_tokens(t) for t in texts]
        tokens: set[str] = set()
        for found in split:
            if found is not None:
                tokens.update(found)
        if tokens:
            self._learn(tokens)
        return [self._encode_tokens(found) if found is not None else self._encode_any(t) for t, found in zip(texts, split)]

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the borders of their spans: piece i covers the original bytes borders[i] to borders[i + 1]."""
        return self.encode_all([text])[0]

    def _encode_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.frombuffer(b"".join(map(self.words.__getitem__, tokens)), "<i4").reshape(-1, 2)
        borders = np.zeros(len(pairs) + 1, np.int64)
        np.cumsum(pairs[:, 1], out=borders[1:])
        borders[1:] -= 1  # the mark before the first word has no space in the text
        return pairs[:, 0], borders

    def _encode_any(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        normal, origin = self.normalize(text)
        found = []
        for part in self.chunks.findall(normal.decode()):
            hit = self.parts.get(part)
            if hit is None:
                hit = self._word(part, False)
                if len(part) <= 64:
                    if len(self.parts) >= CACHE_ENTRIES // 4:
                        self.parts.clear()
                    self.parts[part] = hit
            found.append(hit)
        pairs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
        ids, widths = pairs[:, 0], pairs[:, 1]
        if not self.model.byte_fallback and len(ids):
            first = np.ones(len(ids), bool)  # neighbouring unknown pieces are one
            first[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
            ids, widths = ids[first], np.add.reduceat(widths, np.flatnonzero(first))
        return ids, origin[np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])]

    def _plain_tokens(self, text: bytes) -> list[str] | None:
        """Words of a text in which normalisation only puts a mark for each single space, split before line breaks; None for others."""
        if not self.plain or not text or text[:1] == b" " or text[-1:] == b" " or b"  " in text or self.mark in text:
            return None
        try:
            return text.decode().replace("\n", " \n").split(" ")
        except UnicodeDecodeError:
            return None

    def decode(self, ids: list[int]) -> str:
        shown = list(map(self.surfaces.__getitem__, ids))
        if self.model.add_dummy_prefix or self.model.remove_extra_whitespaces:
            # One leading mark goes (all, if extra spaces are removed), from the first piece that shows anything.
            for i, found in enumerate(ids):
                if self.model.types[found] in (NORMAL, USER_DEFINED, UNUSED) and self.model.pieces[found].startswith(SPACE):
                    shown[i] = shown[i][1:]
                    if shown[i] or not self.model.remove_extra_whitespaces:
                        break
                elif shown[i]:
                    break
        if not any(x in ids for x in self.controls):
            return b"".join(shown).decode("utf-8", "catalink-each")
        borders = [-1, *(i for i, x in enumerate(ids) if x in self.controls), len(ids)]  # no character reaches across one
        return "".join(b"".join(shown[a + 1 : b]).decode("utf-8", "catalink-each") for a, b in zip(borders, borders[1:]))


def encode_texts(
    df: DataFrame, model_path: str, text: str = "text", to: str = "encoding", parts: tuple[str, ...] = ("ids", "borders")
) -> DataFrame:
    """``df`` with a struct column of the asked parts: ``ids`` array<int>, ``borders`` array<long>, ``n_ids`` long, ``n_bytes`` long,
    ``ids_sha256`` (of the decimal ids joined by commas), ``decoded`` (the text decoded from the ids) and ``decoded_sha256``.

    Piece i covers the original UTF-8 bytes from borders[i] up to borders[i + 1] (0-based, one border more than ids); ``n_bytes`` is the
    last border. A null or empty text has no ids and the single border 0. Whole texts are encoded, of any length; equal texts give equal
    results; repeated rows stay. An existing column of the name ``to`` is replaced. The model file is read by the driver and broadcast:
    its size is that of its fixed vocabulary.
    """
    return df.withColumn(to, encode_column(df.sparkSession, model_path, F.col(text), parts))


def encode_column(spark: SparkSession, model_path: str, text: Column, parts: tuple[str, ...] = ("ids", "borders")) -> Column:
    model = spark.sparkContext.broadcast(Model.load(model_path))
    kinds = {"ids": "array<int>", "borders": "array<bigint>", "n_ids": "bigint", "n_bytes": "bigint"}

    def lists(arrays: list[np.ndarray], kind) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0)]).astype(kind)))

    @F.arrow_udf(f"struct<{', '.join(f'{p}: {kinds.get(p, "string")}' for p in parts)}>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value)
        decimals = [str(i).encode() for i in range(len(model.value.pieces))]
        for batch in batches:
            for start in range(0, len(batch), SLICE):
                results = codec.encode_all(text_bytes(batch.slice(start, SLICE)))
                numbers = [r[0].tolist() for r in results] if any(p not in kinds for p in parts) else []
                made = {
                    "ids": lambda: lists([r[0] for r in results], np.int32),
                    "borders": lambda: lists([r[1] for r in results], np.int64),
                    "n_ids": lambda: pa.array([len(r[0]) for r in results], pa.int64()),
                    "n_bytes": lambda: pa.array([int(r[1][-1]) for r in results], pa.int64()),
                    "ids_sha256": lambda: pa.array([sha256(b",".join(map(decimals.__getitem__, x))).hexdigest() for x in numbers]),
                    "decoded": lambda: pa.array([codec.decode(x) for x in numbers], pa.string()),
                    "decoded_sha256": lambda: pa.array([sha256(codec.decode(x).encode()).hexdigest() for x in numbers]),
                }
                yield pa.StructArray.from_arrays([made[p]() for p in parts], list(parts))

    return encode(text)


def decode_column(spark: SparkSession, model_path: str, ids: Column) -> Column:
    """The text of an array of ids; null ids: null. Ids outside the vocabulary are an error."""
    model = spark.sparkContext.broadcast(Model.load(model_path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value)
        for batch in batches:
            flat, ends, gone = batch.values.to_pylist(), batch.offsets.to_pylist(), batch.is_null().to_pylist()
            base = 0
            yield pa.array(
                [None if n else codec.decode(flat[a - base : b - base]) for a, b, n in zip(ends, ends[1:], gone)], pa.string()
            )

    return decode(ids)
