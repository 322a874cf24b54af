"""SentencePiece encoding with source offsets, and decoding.

Normalisation walks the text by the longest prefix that the model's compiled character map holds (a
double-array trie over UTF-8 bytes), and keeps for every normalised byte the source byte that it came
from. White space becomes the visible space mark, pieces are merged by score, unknown characters fall
back to bytes, and each piece is projected through the alignment to a span of source bytes.

Cases: a null or empty text has no pieces and decodes to the empty text; texts of any length are
handled whole; extra columns are left out, so none clashes; repeated rows and rows of null ids are encoded each; of pieces of
equal score the leftmost merge comes first; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Neighbouring, merge
from .common import Remembered, blocks, small_batches, table

SPACE = "▁"
_loaded: dict[str, "Pieces"] = {}


class CharacterMap:
    """The compiled map: size of the trie, the trie's units, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        kind = pb.ModelProto.SentencePiece
        self.score = {p.piece: -p.score for p in model.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces)}
        self.byte_ids = [self.ids[f"<0x{b:02X}>"] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = model.trainer_spec.unk_id
        self.surface = model.trainer_spec.unk_surface
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else b"" if p.type == kind.CONTROL else p.piece.replace(SPACE, " ").encode("utf-8") for p in model.pieces]
        self.bytes[self.unknown] = self.surface.encode("utf-8")
        used = set("".join(self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces with inner spaces need whole-text merging")
        apart = "".join(c for c in "\n\t\r" if c not in used)
        # No piece joins what stands before a space mark to it, or a character of `apart` to anything.
        self.units = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+" + (f"|[{apart}]" if apart else "")).findall
        self.encoded = Remembered(self._encoded)
        self.parts = Remembered(self._parts)
        self.pairs = Neighbouring(self._rank, lambda t: self.parts[t] or None)
        self.longest = max(map(len, self.score), default=1)
        self.inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}

    def normalize(self, text: str) -> tuple[str, np.ndarray | None, int]:
        """The normalised text, source byte of each normalised byte and of the end (None: the same bytes, but for space marks), source bytes skipped at the start."""
        if not self.map.units and not self.trim:
            return ((SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""), None, 0
        data, at, source, normal = text.encode("utf-8"), 0, [], bytearray()
        mark = SPACE.encode("utf-8")

        def put(x: bytes) -> None:
            nonlocal normal
            normal += x
            source.extend([at] * len(x))

        hit = self._mapped(data, 0)
        while self.trim and hit and hit[1] == b" ":
            at += hit[0]
            hit = self._mapped(data, at)
        skipped, spaced = at, self.trim
        if hit and self.dummy:
            put(mark)
        while hit:
            piece = hit[1].lstrip(b" ") if spaced else hit[1]
            put(piece.replace(b" ", mark))
            if piece:
                spaced = self.trim and piece.endswith(b" ")
            at += hit[0]
            hit = self._mapped(data, at)
        while self.trim and normal.endswith(mark):
            at = source[-len(mark)]
            del normal[-len(mark) :], source[-len(mark) :]
        return normal.decode("utf-8"), np.array([*source, at], dtype=np.int32), skipped

    def _mapped(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken at `at`, and what stands for them: a character without an entry for itself; None at the end."""
        if at >= len(data):
            return None
        lead = data[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return self.map.longest(data, at) or (length, data[at : at + length])

    def _rank(self, left: str, right: str) -> float | None:
        return self.score.get(left + right)

    def _parts(self, token: str) -> tuple[float, str, str] | tuple[()]:
        """The last merge in the making of a piece; empty for a single character."""
        if len(token) < 2:
            return ()
        halves = list(token)
        while len(halves) > 2:
            k = min((r, i) for i in range(len(halves) - 1) if (r := self._rank(halves[i], halves[i + 1])) is not None)[1]
            halves[k : k + 2] = [halves[k] + halves[k + 1]]
        return self.score[token], *halves

    def segment(self, unit: str) -> list[str]:
        """Pieces (and unknown characters) of a unit: each prefix's encoding ends in the one piece that can stand after a shorter prefix's."""
        n, score, together, longest = len(unit), self.score, self.pairs.together, self.longest
        if n > 1 and SPACE + SPACE in unit:  # runs of space marks have pieces of one rank
            return merge(list(unit), self._rank)
        last, start = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for k in range(i - longest if i > longest else 0, i):
                piece = unit[k:i]
                if (piece in score or k == i - 1) and (not k or together(last[k], piece)):
                    last[i], start[i] = piece, k
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def _encoded(self, unit: str) -> bytes:
        """Pairs of 32-bit numbers, one pair for each id of a unit: the id, and its length in normalised bytes; a character's fallback bytes carry its length on the last."""
        inner = self.inner
        cuts = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in inner]
        if cuts:  # no piece holds the two characters side by side, so nothing merges across
            return b"".join(self.encoded[unit[a:b]] for a, b in zip([0, *cuts], [*cuts, len(unit)], strict=True))
        out: list[int] = []
        for piece in self.segment(unit):
            if piece in self.score:
                out += self.ids[piece], len(piece.encode("utf-8"))
                continue
            data = piece.encode("utf-8")
            if self.byte_ids is not None:
                for k, b in enumerate(data):
                    out += self.byte_ids[b], len(data) if k == len(data) - 1 else 0
            else:
                out += self.unknown, len(data)
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """ids, and the len(ids) + 1 source bytes where the pieces begin and the last ends."""
        normal, source, skipped = self.normalize(text)
        pairs = np.frombuffer(b"".join(map(self.encoded.__getitem__, self.units(normal))), dtype="<i4").reshape(-1, 2)
        ends = np.cumsum(pairs[:, 1], dtype=np.int64)
        if source is not None:
            bounds = np.concatenate([[skipped], source[ends]])
        else:  # each space mark of three bytes stands for one source byte, the dummy prefix for none
            data = np.frombuffer(normal.encode("utf-8"), dtype=np.uint8)
            extra = np.zeros(len(data) + 1, dtype=np.int32)
            if len(data) > 2:
                marks = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
                if text and SPACE in text:  # a mark written in the source keeps its bytes
                    marks[np.flatnonzero(marks)] = self._made(text)
                extra[3:] = 2 * np.cumsum(marks)
                if self.dummy:
                    extra[3:] += 1
            bounds = np.concatenate([[0], ends - extra[ends]])
        return pairs[:, 0], bounds.astype(np.int32)

    def _made(self, text: str) -> np.ndarray:
        """Of each space mark of the normalised text: whether it stands for a space (or the dummy prefix)."""
        made = [c == " " for c in text if c in (" ", SPACE)]
        return np.array(([True] if self.dummy else []) + made)

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        if self.dummy and ids and out[:1] == b" " and self.ids["<0x20>"] != ids[0]:
            out = out[1:]
        return out.decode("utf-8", "replace")


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), kind))


def encode_pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids, bounds, decoded): ids array<int>, bounds array<int> of len(ids) + 1 source byte offsets (piece k is bytes bounds[k] to bounds[k + 1]), decoded the text that the ids give back."""
    small_batches(df.sparkSession)
    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    schema = source.select(key).schema.add("ids", T.ArrayType(T.IntegerType())).add("bounds", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        p = pieces(path)
        for keys, texts in (x for batch in batches for x in blocks([batch], 1)):
            coded = [p.encode(x or "") for x in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), _lists([i for i, _ in coded], pa.int32()), _lists([b for _, b in coded], pa.int32()), pa.array([p.decode(i.tolist()) for i, _ in coded], pa.string())],
                [key, "ids", "bounds", "decoded"],
            )

    return source.mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.element_at("bounds", -1).cast("long").alias("n_source_bytes"),
        F.xxhash64("bounds").alias("spans_xxhash64"),
    )
