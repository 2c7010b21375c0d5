"""Token ids by a byte-level BPE file of the tokenizers library, with pieces found by the scan and merged in arrays."""

import json

import numpy as np

from cinderspark.llm.bytebpe import PieceEncoder, code_point_classes, texts_as_codes
from cinderspark.llm.merging import Merger
from cinderspark.llm.tokens import _bytes_to_letters as bytes_to_letters


def _merger(tokenizer: str, letters: dict[int, str]) -> Merger | None:
    """The merges of a plain byte-level BPE file; None for other models."""
    with open(tokenizer, encoding="utf-8") as file:
        model = json.load(file)["model"]
    extras = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in extras) or not all(c in model["vocab"] for c in letters.values()):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = model["vocab"]
    left, right, joined = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    return Merger(left, right, joined, np.arange(len(pairs)), np.array([ids[letters[b]] for b in range(256)]))


class ScanEncoder:
    """Ids as little-endian unsigned 32-bit bytes. Pieces of a plain byte-level model are found and merged here; texts with an
    added token in them, and all texts under another model, are encoded by the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = bytes_to_letters()
        splitter = repr(self.tokenizer.pre_tokenizer)
        merger = _merger(path, self.letters)
        plain = self.tokenizer.normalizer is None and splitter == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
        self.pieces = PieceEncoder(merger, code_point_classes(), {}) if merger is not None and plain else None

    def encode(self, texts: list[str]) -> list[bytes]:
        mine = [self.pieces is not None and not any(token in text for token in self.added) for text in texts]
        plain = [text for text, m in zip(texts, mine, strict=True) if m]
        ids = iter(self.pieces.encode(*texts_as_codes(plain)) if plain else [])
        return [
            next(ids) if m else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            for text, m in zip(texts, mine, strict=True)
        ]
