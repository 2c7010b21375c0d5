"""Token ids of whole texts by the tokenizers library, with a memo of pieces that come again.

Text is cut before blanks. With the byte-level splitter such pieces get the same ids alone as in the text,
except where a blank stands between two other white-space characters; texts with that, or with an added
token in them, are encoded whole, and so is everything under another splitter.
"""

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import forget_others, remembers, slices

# Pieces a worker remembers, twice; some 160 MB.
MEMO_PIECES = 450_000
BETWEEN_BLANKS = re.compile(r"\s \s")
BEFORE_BLANK = re.compile(r" \s")
# Fixed value: what the byte-level splitter keeps together.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Marks that the splitter keeps apart from a letter before them.
MARKS = ".,;:!?"


def _bytes_to_letters() -> dict[int, str]:
    """The byte-level vocabulary spells bytes as letters: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Ids of pieces seen of late. When full it becomes the older half, from which pieces in use come back."""

    def __init__(self, tokenizer):
        self.model, self.older = tokenizer.model, {}
        self.letters, self.pattern = _bytes_to_letters(), regex.compile(SPLITTER)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self._new(piece)
        self[piece] = ids
        return ids

    def _new(self, piece: str) -> bytes:
        if not piece[piece[:1] == " " :].isalpha():
            bare = piece.rstrip(MARKS)
            if len(bare) < len(piece) and bare[-1:].isalpha():
                return self[bare] + self[piece[len(bare) :]]
            parts = self.pattern.findall(piece)
            if len(parts) > 1:
                return b"".join(map(self.__getitem__, parts))
        word = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        splitter = repr(self.tokenizer.pre_tokenizer)
        self.splits = self.tokenizer.normalizer is None and splitter == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.memo = _Memo(self.tokenizer)

    def _apart(self, text: str) -> bool:
        """Whether pieces before blanks get the same ids alone."""
        if not self.splits or "\x00" in text or any(token in text for token in self.added):
            return False
        return BEFORE_BLANK.search(text) is None or BETWEEN_BLANKS.search(text) is None

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.memo.__getitem__
        return [
            b"".join(map(get, text.replace(" ", "\x00 ").split("\x00")))
            if self._apart(text)
            else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            for text in texts
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


remembers("tokens", encoder.cache_clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def texts_of(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``keys`` and ``_text``. A null text is empty."""
    return docs.select(*keys, F.coalesce("text", F.lit("")).alias("_text"))


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Inside a task: slices of rows with a ``_text``, and its ids, closed by ``end_id``."""
    forget_others("tokens")
    closing = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    encode = encoder(tokenizer).encode
    for batch in slices(batches):
        yield batch, [x + closing for x in encode(batch.column("_text").to_pylist())]


def with_ids(docs: DataFrame, tokenizer: str, end_id: int | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``ids`` (binary: little-endian unsigned 32-bit), closed by ``end_id``. A null text is empty."""
    narrow = texts_of(docs, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary())], names=[*keys, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", ids binary"
    return narrow.mapInArrow(run, schema)
