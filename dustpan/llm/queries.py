"""The registered queries of this package: ``documents`` and its companions through each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dustpan.llm import (align, brown, centroids, chat, minhash, mixing, oracle, pieces, qda, quality_rules,
                         template_lines, toxicity, warc, winnow)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log of finished conversations, as an interface that streams its answers would have left it.

    Every row opens its message with half of its text and streams the rest;
    assistant messages were first drafted otherwise and generated again, user
    messages mistyped and edited.  Every row is a message of its own, in order
    of turn, role and text with nulls first, so repeated rows and rows of one
    or no turn stay apart; a null conv_id is a conversation of its own, a null
    text an empty one.  Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", text))
    ranked = rows.select("conv_id", place.cast("bigint").alias("msg"), "role", text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    told = F.array(event("start", head), event("delta", tail))
    again = F.array(event("start", tail), event("delta", head), event("regenerate", F.lit("")), event("delta", head), event("delta", tail))
    edited = F.array(event("start", tail), event("edit", F.col("text")))
    log = F.when(F.col("role") == "assistant", again).when(F.col("role") == "user", edited).otherwise(told)
    events = ranked.select("conv_id", "msg", "role", F.posexplode(log).alias("step", "event"))
    return events.select("conv_id", (F.col("msg") * 8 + F.col("step")).alias("seq"), "event.kind", "msg", "role", "event.text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.render(chat.fold(conversation_events(rows.unionByName(planted)))))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edits(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = template_lines.drop_templates(docs, changed="n_dropped")
    return cleaned.select("doc_id", "n_dropped", F.length("text").cast("bigint").alias("n_chars_left"),
                          F.sha2("text", 256).alias("text_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), pieces.read_model(vocabulary_path()))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(docs, copy="copy", order="order_key").select("doc_id", "source", "copy", "order_key")


def _fold(column: str, folds: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves ``which``; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == which, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), _fold("doc_id", 4, 2)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out=held_out)
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold("doc_id", 5, 0)
    scored = qda.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= qda.THRESHOLD).cast("int").alias("predicted"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _fold("doc_id", 7, 2)
    scored = brown.scores(_table(spark, sf_dir, "documents"), training=~_fold("id", 7, 2))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = align.read_vocabularies(vocabulary_path("byte_bpe_50k.json"), vocabulary_path())
    return align.link_scores(_table(spark, sf_dir, "documents"), files)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                            F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module
    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


def all_oracles() -> dict[str, str]:
    return oracle.all_oracles()
