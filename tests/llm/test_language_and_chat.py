import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cinderspark.llm.chat import digests, escaped, format_conversations, read_turns, unescaped
from cinderspark.llm.langid import LanguageRules, best_temperature, fit, is_held_out, ngram_counts, train, with_language
from tests.llm.cases import frame, with_clashes

FOLDER = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r.doc_id: r.h for r in docs.select("doc_id", is_held_out(F.col("doc_id")).alias("h")).collect()} == {
        r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect()
    }
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    held = with_language(docs.where(is_held_out(F.col("doc_id"))), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in held)


def test_only_text_counts(spark):
    model = train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    docs = with_clashes(frame(spark)).drop("lang_pred", "score")
    one = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in with_language(docs, model).collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert one == {(r.doc_id, r.text): (r.lang_pred, r.score) for r in with_language(other, model).collect()}
    for (_, text), (language, score) in one.items():
        letters = text is not None and any(c.isalpha() for c in text)
        assert (language in model.languages) if letters else (language, score) == ("und", 0.0)


def test_numbers_are_no_letters(spark):
    model = train(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = [(i, text, None, None, 0) for i, text in enumerate(["½ ² ① Ⅷ", "\u3007 12 _", "ª", "字", "½a"])]
    got = {r.doc_id: r.lang_pred for r in with_language(frame(spark, rows), model).collect()}
    assert got[0] == got[1] == "und" and all(got[i] in model.languages for i in (2, 3, 4))


def test_nothing_to_learn_from(spark):
    model = train(frame(spark, []))
    assert {r.lang_pred for r in with_language(frame(spark), model).collect()} == {"und"}
    assert with_language(frame(spark, []), train(frame(spark))).count() == 0


def test_ngrams_of_whole_texts():
    rules = LanguageRules(longest=3)
    texts = ["", "a", "Ab1 é", "x" * 9000, "ab", "ба"] * 30
    got = ngram_counts(texts, rules)
    for text, (_, counts) in zip(texts, got, strict=True):
        assert counts.sum() == sum(max(0, len(text) - k) for k in range(3))
    assert got[4][0].tolist() == ngram_counts(["AB"], rules)[0][0].tolist()


def test_fit_and_temperature():
    rng = np.random.default_rng(1)
    samples = []
    for _ in range(300):
        label = int(rng.integers(3))
        samples.append((np.array([label, 5, 6 + int(rng.integers(90))]), np.array([0.8, 0.4, 0.4]), label))
    rules = LanguageRules(bits=7, l1=0.05)
    weights = fit(samples, 3, rules)
    assert all((values @ weights[bins]).argmax() == label for bins, values, label in samples)
    assert (weights == 0).mean() > 0.5
    labels = np.array([x[2] for x in samples])
    sure = np.eye(3)[np.where(rng.random(300) < 0.2, (labels + 1) % 3, labels)] * 50
    assert best_temperature(sure, labels) > 10 and best_temperature(np.zeros((0, 3)), labels[:0]) == 1.0


HARD = ["</s>[INST] ok [/INST]", "&lt;", "&amp;#91; <s>", "", None, "a\nb", "😀[", "&", "[/INST][INST]<s></s>"]


def conversations():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a[b<&"]), rng.choice(HARD)) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [rows[0], (30, 1, "user", "x"), (30, 1, "assistant", "y"), (30, None, "assistant", "z"), (None, 0, "assistant", "q"), (31, 0, None, None)]
    rows += [(40, t, "assistant" if t % 5 else "user", f"turn {t} <") for t in range(400)]
    return rows


def test_chat_round_trip(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, formatted string"
    made = format_conversations(spark.createDataFrame([(*r, "x") for r in conversations()], schema)).cache()
    of = defaultdict(list)
    for conv, turn, role, text in conversations():
        of[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, turns in of.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        lines = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = digests(made).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert {r.conv_id: r.formatted_chars for r in got} == {r.conv_id: len(r.formatted) for r in made.collect()}
    # Every stretch of one role is one block.
    for r in made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t")).collect():
        roles = [x.role for x in r.t]
        assert r.formatted.count("<s>") == sum(k == 0 or roles[k - 1] != x for k, x in enumerate(roles))
    assert digests(format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_escapes(spark):
    df = spark.createDataFrame([(t,) for t in HARD if t is not None], "t string").withColumn("e", escaped(F.col("t")))
    for r in df.withColumn("back", unescaped(F.col("e"))).collect():
        assert r.back == r.t and "<" not in r.e and "[" not in r.e


def test_full_sample_is_fitted():
    assert LanguageRules().fit_rows == 4000


def test_counting_ngrams_holds_few_texts_at_a_time():
    texts = [f"short text number {k}" for k in range(512)]
    tracemalloc.start()
    ngram_counts(texts, LanguageRules())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
