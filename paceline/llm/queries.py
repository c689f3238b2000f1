"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import (
    best_fit,
    collocations,
    fingerprints,
    html,
    langid,
    lexical,
    lm,
    mixing,
    ngram_join,
    packing,
    quality,
    secrets,
    toxicity,
)
from paceline.llm.common import corpus, held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


@query()
def op1_score_text(spark, sf_dir):
    held = held_out(F.col("doc_id"), 7).alias("held")
    return lm.score_documents(corpus(spark, sf_dir).select("doc_id", held, "text"))


@query(mixing.OP2_SQL)
def op2_mix_sources(spark, sf_dir):
    copies = mixing.mix_copies(corpus(spark, sf_dir).select("doc_id", "source", "text"))
    return copies.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


@query()
def op3_find_secrets(spark, sf_dir):
    found = secrets.find_secrets(corpus(spark, sf_dir).select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(i).alias(f"n_{name}") for i, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


@query()
def op4_quality_rules(spark, sf_dir):
    judged = quality.quality(corpus(spark, sf_dir).select("doc_id", "lang", "text"))
    return judged.drop("lang", "text")


@query()
def op5_fingerprints(spark, sf_dir):
    return fingerprints.compare_edits(corpus(spark, sf_dir).select("doc_id", "text"))


@query()
def op6_extract_text(spark, sf_dir):
    return html.extract_main_text(corpus(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op7_toxicity(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    held = held_out(F.col("doc_id"), 4)
    labels = corpus(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    model = toxicity.fit(labels.join(docs, "doc_id"))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "worst_sentence")


@query()
def op8_pack_sequences(spark, sf_dir):
    return packing.pack(corpus(spark, sf_dir).select("doc_id", "text"))


@query()
def op9_identify_language(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("doc_id", "lang", "text")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    found = langid.predict(docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text"), model)
    return found.drop("text")


@query(ngram_join.OP10_SQL)
def op10_ngram_join(spark, sf_dir):
    found = ngram_join.linked(corpus(spark, sf_dir).select("doc_id", "text"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op11_pack_best_fit(spark, sf_dir):
    return best_fit.pack(corpus(spark, sf_dir).select("doc_id", "text"))


@query(lexical.OP12_SQL)
def op12_rank_documents(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("doc_id", "text")
    return lexical.rank(docs, corpus(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(collocations.OP13_SQL)
def op13_mine_phrases(spark, sf_dir):
    return collocations.collocations(corpus(spark, sf_dir).select("lang", "text"))
