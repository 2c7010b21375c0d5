"""Byte pair merging of many pieces at a time.

Pieces stand in the rows of a matrix, one token to a cell. In every round each row joins its pair of lowest rank, the
leftmost of equal ones, and works out the ranks of the two pairs next to it; rows without a pair are done.
"""

import numpy as np

NO_RANK = np.int32(2**31 - 1)
# Bytes of the pieces that stand in a matrix; longer ones are merged one by one.
WIDEST = 48
# Cells of a matrix.
CELLS = 1 << 19


class Merger:
    """``merges``: (left id, right id, joined id) with the lowest rank first; ``byte_ids``: the id of each byte."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray, ranks: np.ndarray, byte_ids: np.ndarray):
        self.size = np.int64(max(int(joined.max(initial=0)), int(byte_ids.max())) + 1)
        keys = left.astype(np.int64) * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.joined = keys[order], ranks[order].astype(np.int32), joined[order].astype(np.int32)
        self.byte_ids = byte_ids.astype(np.int32)
        # Where the pairs of each left id begin, which halves the search, and ranks of pairs of bytes by a look.
        bytes_ = np.arange(256)
        self.first = self._look(self.byte_ids[np.repeat(bytes_, 256)], self.byte_ids[np.tile(bytes_, 256)])

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 if it has no rank."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1).astype(np.int32)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        begin = int(np.searchsorted(lengths[order], 1))
        while begin < len(order):
            width = int(lengths[order[begin]])
            # Rows of up to a quarter more than the shortest, as many as the matrix may have.
            end = int(np.searchsorted(lengths[order], width + width // 4 + 1))
            end = max(min(end, begin + CELLS // (width + width // 4 + 1)), begin + 1)
            rows = order[begin:end]
            if width > WIDEST:
                for row in rows.tolist():
                    out[row] = self._merge_long(pieces[row])
            else:
                self._merge_rows([pieces[r] for r in rows.tolist()], lengths[rows], rows.tolist(), out)
            begin = end
        return out

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray, rows: list[int], out: list[bytes]) -> None:
        m, width = len(pieces), int(lengths.max())
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        row_of = np.repeat(np.arange(m), lengths)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.zeros((m, width), np.int32)
        ids[row_of, column] = self.byte_ids[letters]
        byte = np.zeros((m, width), np.int64)
        byte[row_of, column] = letters
        # Place of each pair in the table and its rank, beside one column that is never the lowest.
        table_rank = np.append(self.ranks, NO_RANK)
        place = np.full((m, width), -1, np.int32)
        place[:, :-1] = self.first[byte[:, :-1] * 256 + byte[:, 1:]]
        place[np.arange(width) >= (lengths - 1)[:, None]] = -1
        rank = table_rank[place]
        size, mine = lengths.copy(), np.arange(m)

        def finish(done: np.ndarray) -> None:
            for k, n, tokens in zip(mine[done].tolist(), size[done].tolist(), ids[done].astype("<u4"), strict=True):
                out[rows[k]] = tokens[:n].tobytes()

        columns = np.arange(width)
        while len(mine):
            at = rank.argmin(axis=1)
            here = np.arange(len(mine))
            done = rank[here, at] == NO_RANK
            if done.any():
                finish(done)
                left = ~done
                ids, place, rank, size, mine, at = ids[left], place[left], rank[left], size[left], mine[left], at[left]
                if not len(mine):
                    break
                widest = int(size.max())
                ids, place, rank, columns = ids[:, :widest], place[:, :widest], rank[:, :widest], columns[:widest]
                here = np.arange(len(mine))
            new = self.joined[place[here, at]]
            # The column after the pair's first goes away.
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), len(columns) - 1)
            ids, place = np.take_along_axis(ids, source, 1), np.take_along_axis(place, source, 1)
            ids[here, at] = new
            size -= 1
            has_next = at < size - 1
            after = np.where(has_next, ids[here, np.minimum(at + 1, len(columns) - 1)], 0)
            place[here, at] = np.where(has_next, self._look(new, after), -1)
            has_last = at > 0
            before = np.maximum(at - 1, 0)
            place[here, before] = np.where(has_last, self._look(ids[here, before], new), place[here, before])
            place[here, size - 1] = -1
            rank = table_rank[place]

    def _merge_long(self, piece: bytes) -> bytes:
        """One piece with a heap: O(n log n)."""
        import heapq

        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\x01") * n
        heap: list[tuple[int, int, int, int]] = []

        def look(i: int) -> None:
            j = after[i]
            if j < n:
                key = ids[i] * int(self.size) + ids[j]
                k = int(np.searchsorted(self.keys, key))
                if k < len(self.keys) and self.keys[k] == key:
                    heapq.heappush(heap, (int(self.ranks[k]), i, key, int(self.joined[k])))

        for i in range(n - 1):
            look(i)
        while heap:
            _, i, key, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] * int(self.size) + ids[j] != key:
                continue
            ids[i], alive[j], after[i] = new, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([t for t, a in zip(ids, alive, strict=True) if a], "<u4").tobytes()


def rank_file_merger(ranks: dict[bytes, int]) -> Merger:
    """Every pair of tokens whose joined bytes are a token may be joined; the rank is that token's id."""
    left, right, joined = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), joined.append(rank)
    new = np.array(joined, np.int64)
    return Merger(np.array(left, np.int64), np.array(right, np.int64), new, new, np.array([ranks[bytes([b])] for b in range(256)]))
