"""Byte-level BPE by a rank file, as the tiktoken library encodes ordinary text, and back.

A batch of texts is one array of code points. Each code point has a class, each class is a function from the
state before it to the state after it, and such functions are composed in blocks side by side (composition is
associative), so that every position learns its state without a pass from left to right. States and their
neighbours tell where pieces begin. Pieces are slices of the UTF-8 bytes; a memo holds the ids of those seen of
late and pair merging works out the others, all of a batch together.
"""

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import byte_slices
from cinderspark.llm.merging import Merger, rank_file_merger

# Bytes of text that are worked on at a time inside a task; a longer text stands alone.
SLICE_BYTES = 1 << 20
# Code points whose states are worked out at a time.
WINDOW = 1 << 19
# Positions that a block of the scan composes.
BLOCK = 64
# The memo holds pieces of at most MEMO_BYTES, about twice MEMO_PIECES of them: some 80 MB.
MEMO_PIECES, MEMO_BYTES = 200_000, 32

# The splitting pattern this module carries out, and the endings it keeps together.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

# What a code point is. Some letters have a class of their own, as an apostrophe may stand before them.
OTHER, LETTER, NUMBER, BLANK, SPACE, QUOTE, LONE, CLASS_R, CLASS_V, CLASS_L, CLASS_E = range(11)
CLASSES = 11
# Where a text stands after a code point. AT_QUOTE: an apostrophe that begins a piece; AT_R, AT_V, AT_L: such a one
# and a letter that may still become an ending; ENDED: an ending is complete.
BEGIN, IN_OTHER, IN_LETTERS, IN_NUMBERS, AT_BLANK, AT_SPACE, AT_QUOTE, AT_R, AT_V, AT_L, ENDED = range(11)
STATES = 11
# What pieces are made of; blanks and other white space are one kind.
KIND = np.array([0, 1, 2, 3, 4, 4, 1, 2, 2, 2, 5], np.uint8)
OTHERS, LETTERS, NUMBERS, WHITE, ENDING = 1, 2, 3, 4, 5


def step(state: int, what: int) -> int:
    """The state after a code point."""
    if what == QUOTE:
        return IN_OTHER if state in (IN_OTHER, AT_QUOTE, AT_BLANK) else AT_QUOTE
    if what in (LONE, CLASS_R, CLASS_V, CLASS_L, CLASS_E, LETTER):
        if state == AT_QUOTE:
            return {LONE: ENDED, CLASS_R: AT_R, CLASS_V: AT_V, CLASS_L: AT_L}.get(what, IN_LETTERS)
        if (state, what) in ((AT_R, CLASS_E), (AT_V, CLASS_E), (AT_L, CLASS_L)):
            return ENDED
        return IN_LETTERS
    return {OTHER: IN_OTHER, NUMBER: IN_NUMBERS, BLANK: AT_BLANK, SPACE: AT_SPACE}[what]


def _transition_functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that runs of classes make of states: (class -> function, function x function -> function,
    function -> state for each state before). Classes from ``CLASSES`` on are those of a text's first code point."""
    identity = tuple(range(STATES))
    simple = [tuple(step(s, c) for s in range(STATES)) for c in range(CLASSES)]
    first = [(step(BEGIN, c),) * STATES for c in range(CLASSES)]
    known = {identity: 0}
    todo = [identity]
    while todo:
        made = todo.pop()
        for generator in simple + first:
            after = tuple(generator[s] for s in made)
            if after not in known:
                known[after] = len(known)
                todo.append(after)
    functions = np.array(list(known), np.uint8)
    composed = np.empty((len(known), len(known)), np.uint16)
    for i, before in enumerate(known):
        for j, after in enumerate(known):
            composed[i, j] = known[tuple(after[s] for s in before)]
    return np.array([known[f] for f in simple + first], np.uint16), composed, functions


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _transition_functions()


def class_table(matches: Callable[[str, str], str]) -> np.ndarray:
    """Class of every code point. ``matches(pattern, text)`` gives all that a pattern matches in a text: what is a letter, a
    number or white space is asked of the library whose ids are to be matched, as Unicode versions differ."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, what in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        table[np.frombuffer(matches(pattern, every).encode("utf-32-le"), np.uint32)] = what
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for ending in ENDINGS:
        if len(ending) == 1:
            table[ord(ending)] = LONE
    table[[ord(c) for c in "rvle"]] = CLASS_R, CLASS_V, CLASS_L, CLASS_E
    return table


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """As the tiktoken library sees them; the tokenizers library sees the same, which a test holds."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}

    def matches(pattern: str, text: str) -> str:
        return bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()

    return class_table(matches)


def scan(functions: np.ndarray, composed: np.ndarray) -> np.ndarray:
    """Each position's composition of all functions up to it. Blocks are composed side by side, then the totals of the
    blocks in the same way, then each block after the total before it."""
    n, size = len(functions), len(composed)
    flat = composed.ravel()
    if n <= BLOCK:
        out = functions.copy()
        for k in range(1, n):
            out[k] = composed[out[k - 1], out[k]]
        return out
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = functions
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    for k in range(1, BLOCK):
        rows[k] = flat[rows[k - 1].astype(np.int32) * size + rows[k]]
    before = np.zeros(blocks, np.uint16)
    before[1:] = scan(rows[-1], composed)[:-1]
    out = flat[before.astype(np.int32)[None, :] * size + rows]
    return out.T.reshape(-1)[:n]


def piece_starts(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which code points begin a piece. ``first`` marks the first one of each text, ``table`` has the classes."""
    per_class, composed, functions = _machine()
    n = len(codes)
    out = np.zeros(n, bool)
    state = BEGIN
    before = np.uint8(BEGIN)
    for a in range(0, n, WINDOW):
        b = min(n, a + WINDOW)
        # One more, as endings and white space depend on what comes next.
        e = min(n, b + 1)
        opens = np.append(first[a:e], True) if e == n else first[a:e]
        what = table[codes[a:e]] + CLASSES * first[a:e].astype(np.uint8)
        states = functions[scan(per_class[what], composed), state]
        m = b - a
        kind = KIND[states]
        kind_next = np.append(kind[1:], 0)[:m]
        ends_text = opens[1 : m + 1]
        last = np.concatenate([[before], states[: m - 1]])
        kind_last = KIND[last]
        now, kind_now = states[:m], kind[:m]
        part_of_ending = (kind_now == ENDING) | ((now >= AT_R) & (now <= AT_L) & (kind_next == ENDING) & ~ends_text)
        starts = (kind_now != kind_last) & ~part_of_ending & ((kind_now == WHITE) | (last != AT_BLANK))
        starts |= (kind_now == WHITE) & ~ends_text & (kind_next != WHITE)
        out[a:b] = starts | first[a:b]
        state, before = int(states[m - 1]), states[m - 1]
    return out


class PieceEncoder:
    """Ids of the pieces of texts. ``whole`` maps pieces that have an id of their own, whatever merging would make of them."""

    def __init__(self, merger: Merger, table: np.ndarray, whole: dict[bytes, int]):
        self.merger, self.table, self.whole = merger, table, whole
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def remember(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Ids of those of ``pieces`` that are not remembered, which are merged together; those of the others are in ``memo``."""
        if len(self.memo) >= MEMO_PIECES:
            # What is in use comes back from the older half.
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        memo.update({p: older[p] for p in pieces - memo.keys() if p in older})
        new = list(pieces - memo.keys())
        whole = [p for p in new if p in self.whole]
        ids = {p: self.whole[p].to_bytes(4, "little") for p in whole}
        parts = [p for p in new if p not in ids]
        ids.update(zip(parts, self.merger.merge_many(parts), strict=True))
        memo.update((p, i) for p, i in ids.items() if len(p) <= MEMO_BYTES)
        return ids

    def encode(self, data: bytes, codes: np.ndarray, first: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes. ``data`` is the UTF-8 of all texts, ``codes`` their code
        points, ``first`` marks those that begin a text, ``ends`` are the ends of texts in ``data``."""
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.cumsum(width, dtype=np.int64) - width
        cuts = at[piece_starts(codes, first, self.table)]
        upto = np.searchsorted(cuts, ends).tolist()
        cuts = [*cuts.tolist(), len(data)]
        pieces = [data[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        new = self.remember(set(pieces))
        # Pieces too long for the memo are among the new ones only.
        get, also = self.memo.get, new.get
        ids = [get(p) or also(p) for p in pieces]
        return [b"".join(ids[a:b]) for a, b in zip([0, *upto[:-1]], upto, strict=True)]


class ByteBPE(PieceEncoder):
    """Ids of texts by merge ranks, and back."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(rank_file_merger(ranks), code_point_classes(), ranks)
        self.ranks = ranks
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for part, rank in ranks.items():
            parts[rank] = part
        self.known = np.zeros(size, bool)
        self.known[list(ranks.values())] = True
        # The vocabulary in one buffer.
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)])
        self.vocabulary = np.frombuffer(b"".join(parts), np.uint8)

    def offsets(self, ids: bytes) -> np.ndarray:
        """Where each token begins in the bytes of its text."""
        lengths = self.lengths[np.frombuffer(ids, "<u4")]
        return np.cumsum(lengths) - lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes of tokens that begin at ``offsets``, gapless from the first of them on: whole texts or any stretch of
        one, many texts at a time. Unknown ids and offsets that do not fit the ids raise."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        if ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        begins = offsets.astype(np.int64) - int(offsets[0])
        if not np.array_equal(begins, np.cumsum(lengths) - lengths):
            raise ValueError("offsets do not fit the ids")
        total = int(begins[-1] + lengths[-1])
        source = np.repeat(self.places[ids] - begins, lengths) + np.arange(total)
        return self.vocabulary[source]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One per Python worker and rank file (lines of base64 and rank)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(part): int(rank) for part, rank in (line.split() for line in lines if line.strip())}
    return ByteBPE(ranks)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_as_codes(whole: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, their code points, which of them begin a text, ends of texts in the UTF-8)."""
    joined = "".join(whole)
    data = joined.encode()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(codes) + 1, bool)
    lengths = np.array([len(t) for t in whole], np.int64)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    ends = np.cumsum(np.array([len(t) if t.isascii() else len(t.encode()) for t in whole], np.int64))
    return data, codes, first[:-1], ends


def encoded(docs: DataFrame, ranks: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` and ``offsets`` (binary: little-endian unsigned 32-bit ids, unsigned 32-bit byte offsets of the
    tokens in the text).

    A null text is an empty one, which has no tokens. Repeated rows and keys that are null or equal stay as they are; other
    columns are not read. Control strings in texts are plain text. Texts are never cut: a long one is worked on alone.
    """
    narrow = docs.select(*[F.col(k) for k in keys], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in byte_slices(batches, "_text", SLICE_BYTES):
            ids = bpe.encode(*texts_as_codes(batch.column("_text").to_pylist()))
            offsets = [bpe.offsets(x).astype("<u4").tobytes() for x in ids]
            columns = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "ids", "offsets"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]) + ", ids binary, offsets binary"
    return narrow.mapInArrow(run, schema)


def decoded(tokens: DataFrame, ranks: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``ids`` and ``bytes`` (binary) of rows as ``encoded`` gives them, or of any stretch of their tokens."""
    narrow = tokens.select(*[F.col(k) for k in keys], "ids", "offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks)
        for batch in byte_slices(batches, "ids", SLICE_BYTES):
            parts = [
                bpe.decode(np.frombuffer(i, "<u4"), np.frombuffer(o, "<u4")).tobytes()
                for i, o in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parts, pa.binary())], names=[*keys, "ids", "bytes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-2]) + ", ids binary, bytes binary"
    return narrow.mapInArrow(run, schema)
