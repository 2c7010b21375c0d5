"""The stages one by one, and as a whole, on documents with planted faults."""

import random

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from cinderspark.llm import common, minhash, tokens
from tests.llm.cases import frame, rows_of, texts, with_clashes


def corpus():
    rng = random.Random(12)
    english = "the of and to in is was that for it with as his on be at by had not are".split()
    french = "le la les de des et à un une est dans que qui pour il ne pas sur été".split()
    rows = []
    for i in range(160):
        words = rng.choices(english if i % 2 else french, k=120)
        for k in range(0, 120, 3):  # so that documents differ
            words[k] += "".join(rng.choices("abcdeio", k=3))
        rows.append([i, " ".join(words), "en" if i % 2 else "fr", f"s{i % 3}", 0])
    for i in range(5):  # near copies
        words = rows[i][1].split()
        words[60] = "changed"
        rows.append([200 + i, " ".join(words), rows[i][2], "s0", 0])
    passage = " ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(50))
    for i in (20, 21, 22):
        rows[i][1] += "\n" + passage
    rows += [[300, "12 34 --", "en", "s1", 0], [301, None, None, None, None], [302, "", "en", "s1", 0]]
    return [tuple(r) for r in rows], passage


def test_stages(spark):
    rows, passage = corpus()
    docs = with_clashes(frame(spark, rows))
    ids = {r[0] for r in rows}
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.schema.names == docs.schema.names, name
        left = {r.doc_id for r in got.select("doc_id").collect()}
        if name == "language_id":
            assert ids - left == {300, 301, 302}
        if name == "minhash_near_dedup":
            assert ids - left == {200, 201, 202, 203, 204}
        if name == "suffix_array_dedup":
            text = {r.doc_id: r.text for r in got.select("doc_id", "text").collect()}
            was = {r[0]: r[1] for r in rows}
            assert left == ids and {i for i in ids if text[i] != was[i]} == {20, 21, 22}
            assert all(passage not in text[i] and len(text[i]) > 500 for i in (20, 21, 22))
        if name == "source_mixing":
            words = {r[0]: len((r[1] or "").split()) for r in rows}
            sums = {}
            for r in got.select("doc_id", "source").collect():
                sums[r.source] = sums.get(r.source, 0) + words[r.doc_id]
            total = sum(words[i] for i in ids)
            assert abs(sums["s2"] / total - 3 / 6) < 0.15 and abs(sums["s0"] / total - 1 / 6) < 0.1
        ids = left
        got.write.parquet(f"{pipeline.shared_folder(spark)}/test-{name}-{random.random()}")
        docs = spark.createDataFrame(got.collect(), got.schema)
    packed = pipeline.pack(spark, docs, "").collect()
    assert {r.doc_id for r in packed} == ids


@pytest.mark.parametrize("long", [3, 40])
def test_copies_keep_to_what_the_mix_takes(spark, long):
    rng = random.Random(long)
    rows = [(i, "w " * rng.randrange(3000, 4000), "en", "long", 0) for i in range(long)]
    rows += [(1000 + i, "w " * rng.randrange(1, 300), "en", "short", 0) for i in range(700)] + [(2000, None, "en", None, 0)]
    docs = frame(spark, rows)
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    wanted, got, most = {}, {}, {}
    for r in pipeline.mix_sources(docs, pipeline.MIX).collect():
        wanted[r.source] = wanted.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    copies = {}
    for r in pipeline.mix(spark, docs, "").collect():
        got[r.source] = got.get(r.source, 0) + words[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3 and got.keys() <= {"long", "short"}
    for source in ("long", "short"):
        assert abs(got.get(source, 0) - wanted[source]) <= 2 * most[source]


@pytest.mark.parametrize("rows", [[], None])
def test_stages_with_odd_rows(spark, rows):
    docs = with_clashes(frame(spark, rows))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.names == docs.schema.names
        stage(spark, docs, "").count()
    assert pipeline.pack(spark, docs, "").count() >= (0 if rows == [] else len(texts()))


def test_repeated_rows_survive_once(spark):
    """Rows that repeat a document, copies without an id, and another text under the id of a kept one."""
    rng = random.Random(3)
    one, two, three, four = (" ".join("".join(rng.choices("abcdefghijk", k=6)) for _ in range(80)) for _ in range(4))
    rows = [(5, one), (5, one), (5, one), (None, two), (None, two), (7, three), (None, three), (6, four), (5, four), (3, four), (9, ""), (9, "")]
    docs = with_clashes(frame(spark, [(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)]))
    once = pipeline.drop_near_duplicates(spark, docs, "")
    want = sorted([(5, one), (None, two), (7, three), (3, four), (9, ""), (9, "")], key=repr)
    assert rows_of(once, "doc_id", "text") == want
    assert rows_of(pipeline.drop_repeated_passages(spark, once, ""), "doc_id", "text") == want


def test_run(spark):
    assert pipeline.ORACLE_SQL is None
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    again = pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows_of(got, "doc_id", "piece", "ids_crc32") == rows_of(again, "doc_id", "piece", "ids_crc32")


@pytest.mark.parametrize("name", ["suffix_array_dedup", "best_fit_packing"])
def test_a_task_needs_one_python_worker_at_a_time(spark, name, monkeypatch):
    rows, _ = corpus()
    written = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, f=DataFrameWriter.parquet, **b: (written.append(self._df), f(self, path, *a, **b))[1])
    written.append(dict(pipeline.STAGES)[name](spark, frame(spark, rows), ""))
    for df in written:
        for stage in df._jdf.queryExecution().executedPlan().toString().split("Exchange"):
            assert stage.count("MapInArrow") <= 1


def test_tasks_drop_what_other_operators_remember():
    tokens.encoder(tokens.default_tokenizer())
    minhash.shingle_set("some words of a text", 2)
    common.forget_others("minhash")
    assert tokens.encoder.cache_info().currsize == 0 and len(minhash._WORDS)
    common.forget_others()
    assert not len(minhash._WORDS)


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["token_counts_by_expression", "op6_exact_top_k", "op9_itq_near_vectors", "op10_chat_format"])
def test_against_sql(spark, name):
    import check_sql

    folder = "/root/testdata/sf0.001"
    theirs = check_sql.connect(folder).execute(entry.oracle_sql()[name]).fetchdf()
    assert check_sql.difference(entry.queries()[name](spark, folder).toPandas(), theirs) is None
