"""Words one letter apart, by a trie of letter counts.

A word's path is its length and then how often it has the letters of each group. Two words that differ by one
letter inserted, deleted or replaced have counts that differ by a surplus of at most one and a deficit of at most one in
all groups together, so a depth-first search that spends this budget meets all of them; the words at its leaves
are then compared letter by letter. The upper part of the trie is worked out by counting jobs and splits the words into
cells of bounded size; below that, each task holds the part of the trie under one cell. A word is asked of
the cells the budget leads to that do not lie before its own, so each pair is met once.
"""

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch, byte_slices, tasks_of

# What a word is made of, and which letters are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Different words a task counts before it hands them on; some 60 MB.
COUNTED_WORDS = 300_000
# Words longer than this are compared one pair at a time.
WIDE = 32
# Pairs of a word and a node that a step of the search expands, and pairs of words compared at a time.
FRAME = 100_000

# Letters in the order of the trie: the frequent ones of Latin-script languages tell most words apart.
ORDER = "eanitrsoludcmhpgbvfkwzyjxq"
# Letters beyond a to z share so many groups.
FURTHER = 6
LEVELS = 1 + len(ORDER) + FURTHER


@dataclass(frozen=True)
class Variants:
    """``ratio``: a form occurs so many times as often as its variants, at least. ``cell_bytes``: letters of the words a task
    holds; ``cell_queries``: words it is asked for; ``bucket``: words of a leaf. The last three change no result."""

    ratio: int = 2
    cell_bytes: int = 2_000_000
    cell_queries: int = 300_000
    bucket: int = 4


def _level_of_letters() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for code in range(256):
        letter = chr(code)
        table[code] = 1 + ORDER.index(letter) if letter in ORDER else 1 + len(ORDER) + code % FURTHER
    return table


LEVEL = _level_of_letters()


class Words:
    """Words of Latin-1 letters as arrays."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.of = np.repeat(np.arange(len(words)), self.lengths)

    def paths(self) -> np.ndarray:
        """One row for each word. Counts stop at 255, which only widens a search."""
        n = len(self.words)
        counts = np.bincount(self.of * LEVELS + LEVEL[self.letters], minlength=n * LEVELS).reshape(n, LEVELS)
        counts[:, 0] = self.lengths
        return np.minimum(counts, 255).astype(np.uint8)

    def matrix(self) -> np.ndarray:
        """The letters of each word that has at most WIDE of them, filled up with zeros."""
        out = np.zeros((len(self.words), WIDE + 1), np.uint8)
        at = np.arange(len(self.letters)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        short = (self.lengths <= WIDE)[self.of]
        out[self.of[short], at[short]] = self.letters[short]
        return out

    def ranks(self) -> np.ndarray:
        """Place of each word in code-point order."""
        out = np.empty(len(self.words), np.int64)
        out[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        return out


class Trie:
    """Items under their paths. A node with at most ``bucket`` items, or one as deep as its first item, is a leaf. ``items``
    maps positions in leaves to the rows given."""

    def __init__(self, paths: np.ndarray, depths: np.ndarray, bucket: int):
        self.items = np.lexsort(paths.T[::-1])
        paths, depths = paths[self.items], depths[self.items]
        self.values, self.first_child, self.lows, self.highs, self.leaves = [], [], [], [], []
        lows, highs = np.array([0]), np.array([len(paths)])
        leaf = (highs - lows <= bucket) | (depths[lows] == 0)
        self.lows.append(lows), self.highs.append(highs), self.leaves.append(leaf)
        for level in range(paths.shape[1]):
            opened = np.flatnonzero(~leaf)
            if not len(opened):
                break
            column = paths[:, level]
            inside = np.zeros(len(paths) + 1, np.int8)
            np.add.at(inside, lows[opened], 1)
            np.add.at(inside, highs[opened], -1)
            begins = np.concatenate([[True], column[1:] != column[:-1]])
            begins[lows[opened]] = True
            begins &= np.cumsum(inside[:-1]) > 0
            child_lows = np.flatnonzero(begins)
            first = np.searchsorted(child_lows, lows)
            last = np.where(leaf, first, np.searchsorted(child_lows, highs))
            ends = np.append(child_lows[1:], len(paths))
            child_highs = np.minimum(ends, np.repeat(highs[opened], (last - first)[opened]))
            self.first_child.append((first, last))
            self.values.append(column[child_lows])
            lows, highs = child_lows, child_highs
            leaf = (highs - lows <= bucket) | (depths[lows] <= level + 1)
            self.lows.append(lows), self.highs.append(highs), self.leaves.append(leaf)

    def search(self, paths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``paths``, row of the items) for all items whose leaf the budget of one surplus and one deficit reaches."""
        n = len(paths)
        nobody = np.zeros(n, np.int8)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), nobody, nobody)]
        while stack:
            level, asks, nodes, surplus, deficit = stack.pop()
            if len(asks) > FRAME:
                half = len(asks) // 2
                stack.append((level, asks[half:], nodes[half:], surplus[half:], deficit[half:]))
                stack.append((level, asks[:half], nodes[:half], surplus[:half], deficit[:half]))
                continue
            ended = self.leaves[level][nodes]
            if ended.any():
                low, high = self.lows[level][nodes[ended]], self.highs[level][nodes[ended]]
                sizes = high - low
                at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                who = np.repeat(asks[ended], sizes)
                for a in range(0, len(who), FRAME):
                    yield who[a : a + FRAME], self.items[at[a : a + FRAME]]
                asks, nodes, surplus, deficit = (x[~ended] for x in (asks, nodes, surplus, deficit))
            if not len(asks):
                continue
            first, last = self.first_child[level]
            sizes = last[nodes] - first[nodes]
            mine = np.repeat(np.arange(len(asks)), sizes)
            child = np.repeat(first[nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(mine))
            more = paths[asks, level].astype(np.int16)[mine] - self.values[level][child]
            if level:
                over, under = surplus[mine] + np.maximum(more, 0), deficit[mine] + np.maximum(-more, 0)
                kept = np.flatnonzero((over <= 1) & (under <= 1))
                over, under = over[kept].astype(np.int8), under[kept].astype(np.int8)
            else:
                kept = np.flatnonzero(np.abs(more) <= 1)
                over, under = surplus[mine[kept]], deficit[mine[kept]]
            stack.append((level + 1, asks[mine[kept]], child[kept], over, under))


def one_apart(a: str, b: str) -> bool:
    """Whether one letter inserted, deleted or replaced makes one word of the other."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def near_pairs(asked: Words, held: Words, held_matrix: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of ``pairs`` that are one letter apart."""
    matrix = asked.matrix()
    for i, j in pairs:
        li, lj = asked.lengths[i], held.lengths[j]
        narrow = (li <= WIDE) & (lj <= WIDE)
        right = np.zeros(len(i), bool)
        same = np.flatnonzero(narrow & (li == lj))
        right[same] = (matrix[i[same]] != held_matrix[j[same]]).sum(axis=1) == 1
        for at, long_, short in (
            (np.flatnonzero(narrow & (li == lj + 1)), (matrix, i), (held_matrix, j)),
            (np.flatnonzero(narrow & (li + 1 == lj)), (held_matrix, j), (matrix, i)),
        ):
            longer, shorter = long_[0][long_[1][at]], short[0][short[1][at]]
            # The first place where they differ, and the last one where the longer, moved by one, still does.
            differ = (longer != shorter).argmax(axis=1)
            moved = longer[:, 1:] != shorter[:, :-1]
            last = np.where(moved.any(axis=1), WIDE - 1 - moved[:, ::-1].argmax(axis=1), -1)
            right[at] = last < differ
        for k in np.flatnonzero(~narrow & (np.abs(li - lj) <= 1)).tolist():
            right[k] = one_apart(asked.words[i[k]], held.words[j[k]])
        found = np.flatnonzero(right)
        if len(found):
            yield i[found], j[found]


def word_counts(docs: DataFrame, change: Callable[[str, str], str] | None = None, key: str = "doc_id", least_n: int = 3, least_length: int = 5) -> DataFrame:
    """(``word``, ``n``): maximal runs of letters with A to Z lower-cased, as ``change(key as text, run)`` gives them, of at least
    ``least_length`` letters and ``least_n`` occurrences. Null texts have none; a null key is ''. Each row counts, also a
    repeated one."""
    narrow = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col("text").alias("_text")).where("_text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in byte_slices(batches, "_text"):
            for name, text in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                begin = zlib.crc32(f"{name}:".encode())
                found: dict[str, int] = {}
                for raw, n in Counter(RUN.findall(text)).items():
                    word = raw.lower() if raw.isascii() else raw.translate(LOWER)
                    found[word] = found.get(word, 0) + n
                for word, n in found.items():
                    if change is not None:
                        word = change(begin, word)
                    if len(word) >= least_length:
                        counts[word] = counts.get(word, 0) + n
            if len(counts) >= COUNTED_WORDS:
                yield given()
                counts.clear()
        if counts:
            yield given()

    parts = narrow.mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def dropped_letter(every: int) -> Callable[[int, str], str]:
    """A seeded slip of the pen: where ``every`` divides the crc32 of ``key:run``, the letter at that crc32 modulo the length is
    gone. The function gets the crc32 of ``key:``, which goes on over the run."""

    def change(begin: int, word: str) -> str:
        h = zlib.crc32(word.encode(), begin)
        if h % every:
            return word
        i = h % len(word)
        return word[:i] + word[i + 1 :]

    return change


@dataclass(frozen=True)
class Cell:
    """The words under a path; ``chunks`` beyond 1 only where a whole path is not enough to split them."""

    path: bytes
    chunks: int


def _with_paths(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "word"):
            rows = Words(batch.column("word").to_pylist()).paths()
            path = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, path], names=["word", "n", "path"])

    return words.mapInArrow(run, "word string, n bigint, path binary")


def cells(words: DataFrame, cell_bytes: int) -> list[Cell]:
    """The upper trie: nodes with more than ``cell_bytes`` letters are split by their next level. At most letters /
    cell_bytes nodes of a level are that large, which bounds what comes to the driver to their children."""
    size = F.sum(F.length("word") + 1)
    total = words.agg(size).first()[0] or 0
    done, large = [], {b"": total}
    if total <= cell_bytes:
        done, large = [Cell(b"", 1)], {}
    for depth in range(1, LEVELS + 1):
        if not large:
            break
        parent = words.sparkSession.createDataFrame([(bytearray(p),) for p in large], "_parent binary")
        inside = words.join(F.broadcast(parent), F.substring("path", 1, depth - 1) == F.col("_parent")) if depth > 1 else words
        sizes = inside.groupBy(F.substring("path", 1, depth).alias("path")).agg(size.alias("size")).collect()
        small = [r for r in sizes if r["size"] <= cell_bytes or depth == LEVELS]
        done += [Cell(bytes(r["path"]), -(-r["size"] // cell_bytes)) for r in small]
        large = {bytes(r["path"]): r["size"] for r in sizes if r["size"] > cell_bytes and depth < LEVELS}
    return sorted(done, key=lambda c: c.path)


def _routed(words: DataFrame, upper: list[Cell]) -> DataFrame:
    """(``cell``, ``chunk``, ``asks``, ``own``, ``word``, ``n``): each word once where it is held, and once for each chunk of each
    cell it is asked of, none before its own."""
    chunks = np.array([c.chunks for c in upper], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.zeros((len(upper), LEVELS), np.uint8)
        for k, c in enumerate(upper):
            padded[k, : len(c.path)] = np.frombuffer(c.path, np.uint8)
        trie = Trie(padded, np.array([len(c.path) for c in upper]), 0)
        paths_in_order = [c.path for c in upper]
        for batch in byte_slices(batches, "word", 1 << 18):
            rows = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).reshape(-1, LEVELS)
            own = np.array([_cell_of(paths_in_order, r.tobytes()) for r in rows], np.int64)
            crc = np.array([zlib.crc32(w.encode()) for w in batch.column("word").to_pylist()], np.int64)
            found = list(trie.search(rows))
            who, where = (np.concatenate(x) for x in zip(*found, strict=True))
            ahead = where >= own[who]
            who, where = who[ahead], where[ahead]
            times = chunks[where]
            turn = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            who, where = np.repeat(who, times), np.repeat(where, times)
            n = len(rows)
            row = np.concatenate([np.arange(n), who])
            columns = [
                pa.array(np.concatenate([own, where]).astype(np.int32)),
                pa.array(np.concatenate([crc % chunks[own], turn]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(n, bool), np.ones(len(who), bool)])),
                pa.array(np.concatenate([np.ones(n, bool), where == own[who]])),
                batch.column("word").take(pa.array(row)),
                batch.column("n").take(pa.array(row)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "chunk", "asks", "own", "word", "n"])

    return words.mapInArrow(run, "cell int, chunk int, asks boolean, own boolean, word string, n bigint")


def _cell_of(paths: list[bytes], path: bytes) -> int:
    """No cell's path begins another's, so the last one not above a word's path is its cell."""
    return bisect_right(paths, path) - 1


def _best(target: np.ndarray, n: np.ndarray, rank: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each target: how many others, and the other of largest n, of equal ones that of least rank."""
    order = np.lexsort((rank, -n, target))
    begins = np.flatnonzero(np.diff(target[order], prepend=-1))
    return target[order][begins], np.diff(begins, append=len(order)), other[order][begins]


def _searched(routed: DataFrame, rules: Variants, tasks: int) -> DataFrame:
    """(``word``, ``n_near``, ``near_n``, ``near``): what each task found for a word: how many near words, and the best."""
    asked = routed.where("asks").groupBy("cell", "chunk").agg(F.count(F.lit(1)).alias("asked"))
    # One row for each cell and chunk; the planner looks at its size.
    salted = routed.join(asked.withColumn("salts", F.ceil(F.col("asked") / rules.cell_queries).cast("int")), ["cell", "chunk"])
    every = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = salted.select("cell", "chunk", F.explode(every).alias("salt"), "asks", "own", "word", "n")
    dealt = dealt.repartition(tasks, "cell", "chunk", "salt").sortWithinPartitions("cell", "chunk", "salt", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, collected, held = None, [], None
        for batch in batches:
            parts = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "chunk", "salt", "asks")]
            changes = np.zeros(batch.num_rows, bool)
            for p in parts:
                changes[1:] |= p[1:] != p[:-1]
            cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part, asks = tuple(int(p[a]) for p in parts[:3]), bool(parts[3][a])
                if part != here:
                    here, collected, held = part, [], None
                rows = batch.slice(a, b - a)
                if not asks:
                    collected.append(rows)
                    continue
                if held is None and not collected:
                    # A chunk that holds no word.
                    continue
                if held is None:
                    table = pa.Table.from_batches(collected)
                    words = Words(table.column("word").to_pylist())
                    trie = Trie(words.paths(), np.full(len(words.words), LEVELS), rules.bucket)
                    held = words, words.matrix(), words.ranks(), table.column("n").to_numpy(), trie
                    collected = []
                yield from found_in(rows, *held)

    def found_in(rows: pa.RecordBatch, held: Words, matrix: np.ndarray, ranks: np.ndarray, n: np.ndarray, trie: Trie) -> Iterator[pa.RecordBatch]:
        asked = Words(rows.column("word").to_pylist())
        own = rows.column("own").to_numpy(zero_copy_only=False)
        asked_n = rows.column("n").to_numpy()
        found = list(near_pairs(asked, held, matrix, trie.search(asked.paths())))
        if not found:
            return
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        # In a word's own cell both of a pair are asked for.
        if own.any():
            once = np.array([not own[x] or asked.words[x] < held.words[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            i, j = i[once], j[once]
        for target, words, other_n, other_rank, other, names in (
            (i, asked.words, n[j], ranks[j], j, held.words), (j, held.words, asked_n[i], asked.ranks()[i], i, asked.words),
        ):
            if not len(target):
                continue
            which, near, best = _best(target, other_n, other_rank, other)
            counts = (asked_n if names is asked.words else n)[best]
            columns = [[words[k] for k in which.tolist()], near, counts, [names[k] for k in best.tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "n_near", "near_n", "near"])

    return dealt.mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")


def spelling_variants(words: DataFrame, rules: Variants = Variants()) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of words (``word``, ``n``), each of which is there once.

    Two words are near if one letter inserted, deleted or replaced makes one of the other. A word's form is its near word of
    largest ``n`` (the smallest word of equal ones) if that is at least ``ratio`` times its own; its root is where forms
    lead. Words are of letters up to U+00FF; null words are dropped. No near word is left out. An empty table gives none.
    """
    spark = words.sparkSession
    scratch, tasks = Scratch(spark, "variants"), tasks_of(spark)
    pathed = scratch.keep(_with_paths(words.select("word", "n").where("word IS NOT NULL")), "words", 10_000)
    upper = cells(pathed, rules.cell_bytes)
    routed = scratch.keep(_routed(pathed, upper), "routed", 10_000)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    found = _searched(routed, rules, tasks).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    strong = -F.col("best.n") >= rules.ratio * F.col("n")
    near = pathed.select("word", "n").join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n"),
    )
    near = scratch.keep(near, "near")
    scratch.drop("routed")
    # Counts grow by ``ratio`` with every step, so forms lead on for a few steps only; each round takes twice as many.
    roots, step = near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = scratch.keep(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), f"roots-{step}")
        roots, step = moved.select("word", "root"), step + 1
        if moved.where("moved").isEmpty():
            break
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
