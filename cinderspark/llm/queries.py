"""The training-data operators applied to the test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.llm.alignment import align, default_pair
from cinderspark.llm.bytebpe import decoded, default_ranks, encoded
from cinderspark.llm.chat import digests, format_conversations
from cinderspark.llm.common import Scratch
from cinderspark.llm.huffman import read_corpus, write_corpus
from cinderspark.llm.itq import NearVectors, near_vectors
from cinderspark.llm.langid import is_held_out, train, with_language
from cinderspark.llm.minhash import NearDuplicates, near_duplicates
from cinderspark.llm.mixing import mix_sources, word_count
from cinderspark.llm.packing import pack_documents
from cinderspark.llm.suffix import Repeats, without_repeats
from cinderspark.llm.token_counts import rollup
from cinderspark.llm.tokens import default_tokenizer
from cinderspark.llm.topk import TopK, exact_top_k
from cinderspark.llm.variants import dropped_letter, spelling_variants, word_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROLLUP_SQL = r"""
    WITH revised AS (
      SELECT source, lang, regexp_replace(coalesce(text, ''), '[%*&$]{3,}', '', 'g') AS t
      FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE text IS NULL OR doc_id IS NULL OR doc_id = first
    ), counted AS (
      SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n FROM revised
      UNION ALL SELECT source, lang, 'bytes-1', octet_length(encode(t)) FROM revised
    )
    SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counted GROUP BY source, lang, tokenizer
"""
EXPRESSIONS = {"words-1": word_count, "bytes-1": F.octet_length}


@query("op1_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(spark, table(spark, sf_dir, "documents"), EXPRESSIONS, {"byte-bpe-50k": default_tokenizer()})


@query("token_counts_by_expression", ROLLUP_SQL)
def token_counts_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(spark, table(spark, sf_dir, "documents"), EXPRESSIONS, {})


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=1024, end_id=2)


@query("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op4_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'token-files').folder}"
    write_corpus(table(spark, sf_dir, "documents"), folder, default_tokenizer(), end_id=2)
    return read_corpus(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_minhash_dedup")
def minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDuplicates(words=4))


@query(
    "op6_exact_top_k",
    """
    WITH v AS (
      SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 10
    """,
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), TopK(k=10, scale=1024, every=100))


@query(
    "op10_chat_format",
    """
    WITH rows_ AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
      SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS r,
        replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS role_before
      FROM rows_
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(length(t) + CASE WHEN role_before = role THEN 7 ELSE length(r) + 3 + 6 + 4 END) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    predicted = with_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    "op9_itq_near_vectors",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach AS (
      SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.a
    ), n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, low AS component_id, vec_id = low AS kept
    FROM embeddings JOIN (SELECT a, min(r) AS low FROM reach GROUP BY a) m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
)
def itq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), NearVectors(cosine=0.98))


@query("op7_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return without_repeats(docs, Repeats(span=200)).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        lengths.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), default_pair()).documents


@query("op12_spelling_variants")
def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), dropped_letter(97)))


@query("op13_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decoded(encoded(table(spark, sf_dir, "documents"), default_ranks()), default_ranks())
    return back.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
