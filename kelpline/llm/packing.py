"""Packing by power-of-two decomposition: every piece is a sequence of its own, so none crosses documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

MAX_LENGTH = 4096
END = 2
#: Pieces whose ids a Python worker remembers, in two generations; the memory of a worker stays under some 200 MB.
REMEMBERED = 600_000
#: Longer pieces aren't remembered.
LONGEST_REMEMBERED = 64
#: Characters that need no normalisation but lower case, and the pieces of a text: these are fixed values of tokenizers with
#: the parts PARTS, for these characters. A file with other parts has its texts encoded whole.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
NOT_PLAIN = re.compile(r"[^\x20-\x7E\x09-\x0DÀ-ÖØ-öø-ÿ]")
PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\sa-zß-öø-ÿ0-9]+")
PIECES = "doc_id long, start long, length long, input_ids binary, doc_tokens long"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from
    U+0100 for bytes that don't print."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class PieceIds:
    """The ids of a text as bytes, piece by piece. The tokenizer never joins text across a piece, so a text's ids are
    those of its pieces, one after another. Most pieces of a corpus were seen lately; a new one goes straight to the
    merges of the tokenizer's model. Words with characters outside NOT_PLAIN's list go through the whole tokenizer."""

    _of_path: dict[str, PieceIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_pieces = told["model"]["type"] == "BPE" and all(told[part] == PARTS[part] for part in PARTS)
        self.merged = self.tokenizer.model.tokenize
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceIds:
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def _piece(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.merged(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
            ids = pack_ids(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.recent) >= REMEMBERED // 2:
                self.recent, self.older = {}, self.recent
            self.recent[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = PIECE.findall(text.lower())
        ids = list(map(self.recent.get, pieces))
        if None in ids:
            new = {p: self._piece(p) for p, i in zip(pieces, ids, strict=True) if i is None}
            ids = [new[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
        return b"".join(ids)

    def text(self, text: str) -> bytes:
        if not self.by_pieces or any(m in text for m in self.markers):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not NOT_PLAIN.search(text):
            return self._plain(text)
        ids, plain = [], []
        for word in text.split(" "):
            if NOT_PLAIN.search(word):
                ids.append(self._plain(" ".join(plain)))
                ids.append(np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes())
                plain = []
            else:
                plain.append(word)
        return b"".join([*ids, self._plain(" ".join(plain))])


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """``n`` as pieces of the longest length, then of falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, longest: int) -> Iterator[pa.RecordBatch]:
    known = PieceIds.of(path)
    end = np.array([END], "<u4").tobytes()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    names = ["doc_id", "start", "length", "input_ids", "doc_tokens"]
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = known.text(text.as_py()) + end
            n, start = len(ids) // 4, 0
            for length in piece_lengths(n, longest):
                out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n))
                start += length
            held += len(ids)
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): doc_id, start, length, input_ids (little-endian unsigned 32-bit
    ids), doc_tokens, bucket (log2 of the length), sequence_id, offset.

    A document is its ids and a final END; a null or empty text is END alone. It is cut into pieces of ``longest`` and
    then of falling powers of two. A piece is a whole sequence, so nothing is padded: a batch takes sequences of one
    bucket. Ids of sequences are unique, and the same for the same input files; they need no shuffle, and neither does
    anything else here. Rows with equal or null ids each have their pieces; no rows give none.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = slim.mapInArrow(lambda batches: _pieces(batches, tokenizer_path, longest), PIECES)
    return pieces.withColumns(
        {
            "bucket": F.log2(F.col("length").cast("double")).cast("int"),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), default_tokenizer()))
