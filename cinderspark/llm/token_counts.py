"""The corpus's token counts through a load and a revision."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderspark.llm.common import Scratch
from cinderspark.llm.ledger import Ledger, deletes, document_counts, inserts, revisions

JUNK = r"[%*&$]{3,}"


def rollup(spark: SparkSession, docs: DataFrame, expressions: dict[str, Callable[[Column], Column]], files: dict[str, str]) -> DataFrame:
    """Totals after two batches over all documents.

    ``load`` inserts every document. ``revise`` withdraws exact copies (rows of the smallest doc_id stay, as do rows
    without a text or an id) and recounts the documents that have runs of junk marks once these are taken out.
    The second batch is sent twice, as a retry would.
    """
    scratch = Scratch(spark, "token-counts")
    marked = docs.select("doc_id", "source", "lang", "text", F.md5(F.col("text").cast("binary")).alias("copy_of"))
    marked = marked.withColumn("junk", F.coalesce(F.col("text").rlike(JUNK), F.lit(False)))
    copied = marked.groupBy("copy_of").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copied = scratch.keep(copied.where(F.col("copy_of").isNotNull()), "copied")
    gone = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))

    loaded = scratch.keep(document_counts(marked, expressions, files, keep=("doc_id", "copy_of", "junk")), "loaded")
    ledger = Ledger(spark, f"{scratch.folder}/ledger")
    ledger.commit("load", inserts(loaded))

    known = loaded.join(copied, "copy_of", "left")
    junk = marked.where("junk").join(copied, "copy_of", "left").where(~gone).withColumn("text", F.regexp_replace("text", JUNK, ""))
    for _ in range(2):
        ledger.commit("revise", deletes(known.where(gone)), revisions(known.where(~gone & F.col("junk")), document_counts(junk, expressions, files)))
    return ledger.totals()
