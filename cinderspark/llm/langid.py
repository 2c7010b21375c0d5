"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by a temperature."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderspark.llm.common import bundled, forget_others, slices, unbundled

UNKNOWN = "und"
# Texts whose counts are held at a time, each in an array of all bins.
_BATCH = 8


@dataclass(frozen=True)
class LanguageRules:
    """N-grams of 1..``longest`` characters fall into 2 ** ``bits`` bins. Document frequencies cover all labelled
    rows. ``fit_rows`` bounds the labelled rows that are fitted on (about as many of each language); a fifth of
    them sets the temperature."""

    longest: int = 4
    bits: int = 15
    fit_rows: int = 4000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    rules: LanguageRules
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bins + 1 (bias) by languages
    temperature: float


def ngram_counts(texts: list[str], rules: LanguageRules) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bins, counts) of each whole text. Case is folded; characters but letters and marks beyond ASCII count as
    one blank."""
    size = 1 << rules.bits
    out = []
    for begin in range(0, len(texts), _BATCH):
        codes = [np.frombuffer(t.lower().encode("utf-32-le"), "<u4") for t in texts[begin : begin + _BATCH]]
        n = np.array([len(c) for c in codes])
        all_ = np.concatenate([*codes, np.zeros(0, "<u4")]).astype(np.uint64)
        all_[(all_ < 128) & ~((all_ >= 97) & (all_ <= 122))] = 32
        of = np.repeat(np.arange(len(codes)), n)
        total = np.zeros(len(codes) * size, np.int64)
        rolling = np.zeros(len(all_), np.uint64)
        for k in range(min(rules.longest, len(all_))):
            rolling = rolling[: len(all_) - k] * np.uint64(0x100000001B3) + all_[k:] + np.uint64(k + 1)
            here = of[: len(rolling)]
            inside = here == of[k:]
            bins = (rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - rules.bits)
            total += np.bincount(here[inside] * size + bins[inside].astype(np.int64), minlength=len(total))
        used = np.flatnonzero(total)
        cuts = np.searchsorted(used, np.arange(len(codes) + 1) * size)
        out += [(used[a:b] - k * size, total[used[a:b]]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return out


def weighted(bins: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[bins]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, rules: LanguageRules) -> np.ndarray:
    """FTRL-proximal over (bins, values, class); returns the weights, the bias in the last row."""
    size = (1 << rules.bits) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def now(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= rules.l1, 0.0, -(zs - np.sign(zs) * rules.l1) / ((rules.beta + np.sqrt(ns)) / rules.alpha + rules.l2))

    rng = np.random.default_rng(rules.seed)
    for _ in range(rules.epochs):
        for i in rng.permutation(len(samples)):
            bins, values, label = samples[i]
            zs, ns = z[bins], n[bins]
            w = now(zs, ns)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            grown = ns + g * g
            z[bins] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / rules.alpha * w
            n[bins] = grown
    return now(z, n)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Least cross-entropy on a grid of temperatures. Targets are smoothed by one part in n + 2, so that few held
    rows without an error don't call for certainty."""
    n, classes = logits.shape
    if not n:
        return 1.0
    target = np.full(logits.shape, 1.0 / (n + 2) / classes)
    target[np.arange(n), labels] += 1 - 1.0 / (n + 2)

    def loss(t: float) -> float:
        x = logits / t
        top = x.max(1)
        return float((np.log(np.exp(x - top[:, None]).sum(1)) + top - (target * x).sum(1)).mean())

    return min(np.exp(np.linspace(np.log(0.02), np.log(20), 200)).tolist(), key=loss)


def has_letter(text: str) -> bool:
    """Numbers that look like letters, such as fractions or roman ones, are none."""
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, rules: LanguageRules = LanguageRules()) -> LanguageModel:
    """Learn from ``doc_id``, ``text`` and ``lang`` (rows with a null text or lang do not count)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # One row per language.
    per_language = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per_language)
    if not languages:
        return LanguageModel(rules, [], np.ones(1 << rules.bits), np.zeros(((1 << rules.bits) + 1, 0)), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        seen = np.zeros(1 << rules.bits, np.int64)
        for batch in slices(batches):
            for bins, _ in ngram_counts(batch.column("text").to_pylist(), rules):
                seen[bins] += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["bin", "n"])

    # At most 2 ** bits rows.
    found = rows.select("text").mapInArrow(frequencies, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << rules.bits)
    for r in found:
        df[r["bin"]] = r["n"]
    idf = np.log((1 + sum(per_language.values())) / (1 + df)) + 1

    narrow = "<u2" if rules.bits < 16 else "<i4"  # bins, and the bias after them

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            grams = ngram_counts(batch.column("text").to_pylist(), rules)
            columns = [
                batch.column("draw"), batch.column("lang"), pa.array([b.astype(narrow).tobytes() for b, _ in grams], pa.binary()),
                pa.array([c.astype("<i4").tobytes() for _, c in grams], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["draw", "lang", "bins", "counts"])

    share = F.lit(0.0)
    for language, n in per_language.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, rules.fit_rows / len(languages) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(rules.seed)), F.lit(1 << 40))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share * float(1 << 40)).select("draw", "lang", "text")
    # The bound on fitted rows; the draw keeps to it but for chance.
    sample = drawn.mapInArrow(counted, "draw bigint, lang string, bins binary, counts binary").limit(2 * rules.fit_rows).collect()
    sample.sort(key=lambda r: (-r["draw"], r["lang"], bytes(r["bins"][:64]), len(r["bins"]), bytes(r["counts"][:64])))
    bias = np.array([1 << rules.bits], narrow)
    points = []
    while sample:  # a row goes as soon as it is unpacked, so that the driver holds the sample once
        r = sample.pop()
        bins, counts = np.frombuffer(r["bins"], narrow), np.frombuffer(r["counts"], "<i4")
        values = np.concatenate([weighted(bins, counts, idf), [1.0]]).astype(np.float32)
        points.append((np.concatenate([bins, bias]), values, languages.index(r["lang"])))
    held = points[::5] if len(points) >= 50 else []
    fitted = [p for k, p in enumerate(points) if not held or k % 5]
    weights = fit(fitted, len(languages), rules)
    logits = np.array([values @ weights[bins] for bins, values, _ in held]).reshape(-1, len(languages))
    return LanguageModel(rules, languages, idf, weights, best_temperature(logits, np.array([label for *_, label in held], int)))


def with_language(docs: DataFrame, model: LanguageModel, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs``, the predicted language and its calibrated probability (0 to 1), from whole texts; these
    two take the place of columns of their names.

    A null text, one without a letter, and any text under a model that saw no language is ``und`` with 0.
    """
    narrow = bundled(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            known = [k for k, t in enumerate(texts) if model.languages and t is not None and has_letter(t)]
            languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            for k, (bins, counts) in zip(known, ngram_counts([texts[k] for k in known], model.rules), strict=True):
                logits = (weighted(bins, counts, model.idf) @ model.weights[bins] + model.weights[-1]) / model.temperature
                p = np.exp(logits - logits.max())
                best = int(p.argmax())
                languages[k], scores[k] = model.languages[best], float(p[best] / p.sum())
            columns = [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "_rest", language, score])

    predicted = narrow.mapInArrow(run, narrow.withColumns({language: F.lit(""), score: F.lit(0.0)}).schema)
    columns = [c for c in docs.columns if c not in (language, score)]
    return unbundled(predicted, [*columns, language, score], "text", language, score)


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
