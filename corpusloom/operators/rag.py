"""Answers to tables of conversations: request checks, analysis, searches, context, generation, responses, as one plan.

Providers are callables on the executors: `embed(texts) -> vectors`, `generate(prompts) -> texts`, called once for each
batch of rows; what they raise becomes the error of their rows (see `upload.ProviderError`), never of the job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import answer, query, retrieval, upload
from corpusloom.operators.corpus import Settings
from corpusloom.operators.ordered import stored


def latest_questions(messages: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, question, retrieval_text, said, valid, too_large) of each conversation (conv_id, turn, role, text).

    The question is the last message; said: the last messages, oldest first, as array<struct<role, text>>. A request is
    refused (valid false, or too_large) as `query.validate_requests` says.
    """
    checked = query.validate_requests(messages, max_chars=settings.max_message_chars).select(F.col("conv_id").alias("query_id"), "valid", "too_large")
    users = query.user_questions(messages)
    last = users.groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by(F.struct("question", "retrieval_text"), "turn").alias("q"))
    recent = query.history(messages, settings.max_history_messages)
    said = recent.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
    out = checked.join(last, "query_id", "left").join(said, "query_id", "left")
    return out.select("query_id", "q.question", "q.retrieval_text", F.transform("_m",
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("said"), "valid", "too_large")


def generated(prompts: DataFrame, generate: Callable[[list[str]], list[str]], retries: int = upload.RETRIES, sleep=None) -> DataFrame:
    """(query_id, text, code): the generated text of each prompt, or the HTTP code of the failure (0 without one)."""
    kind = prompts.schema["query_id"].dataType.simpleString()
    wait = {} if sleep is None else {"sleep": sleep}

    def run(batches):
        for batch in batches:
            codes: list = []

            def call(texts=batch["prompt"].tolist()):
                try:
                    return generate(texts)
                except upload.ProviderError as e:
                    codes.append(e.code or 0)
                    raise

            texts, failed = upload.with_retries(call, retries, **wait)
            n = len(batch)
            wrong = failed is not None or len(texts) != n
            yield pd.DataFrame({"query_id": batch["query_id"], "text": [None] * n if wrong else texts,
                "code": [codes[-1] if codes else 0] * n if wrong else [None] * n})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, text string, code int")


def answer_questions(messages: DataFrame, chunks: DataFrame | None, vectors: DataFrame | None, embed, generate, settings: Settings = Settings(),
    sleep=None) -> DataFrame:
    """(query_id, answer, citations, guide, error) for each conversation; error: struct<code, status> where there is no answer.

    chunks: rows of `retrieval.row_defaults`, images among them; vectors: (id, embedding). Without chunks the model is
    asked from its own knowledge and nothing is cited. Each provider's results are stored before they are used, so that
    none is asked twice.
    """
    asked = stored(latest_questions(messages, settings))
    fine = asked.where("valid and not too_large")
    if chunks is None:
        prompts = fine.select("query_id", answer.prompt(F.col("said"), None).alias("prompt"))
        contexts = None
    else:
        analysed = query.analyze(fine.select("query_id", "retrieval_text"))
        texts = analysed.select(F.col("query_id").cast("string").alias("content_hash"), F.col("retrieval_text").alias("embedding_text"))
        wait = {} if sleep is None else {"sleep": sleep}
        vecs = stored(upload.embed(texts, embed, settings.dimensions, **wait).where("vector is not null")).select(F.col("key").alias("_q"),
            F.col("vector").alias("query_vec"))
        ready = stored(analysed.join(vecs, F.col("query_id").cast("string") == F.col("_q")).drop("_q").withColumn("query_text",
            F.col("retrieval_text")))
        found = retrieval.hybrid(ready, chunks, vectors, settings.initial_top)
        how = ready.where("procedural_intent")
        pictures = retrieval.hybrid(how, chunks, vectors, settings.image_top_k, images=True)
        evidence, shown = retrieval.retrieve(ready, found, pictures, settings.min_score, settings.max_evidence, settings.max_images)
        contexts = stored(answer.build_context(evidence, shown))
        prompts = ready.select("query_id").join(fine.select("query_id", "said"), "query_id").join(contexts.select("query_id", "context"), "query_id",
            "left").select(
            "query_id", answer.prompt(F.col("said"), F.col("context")).alias("prompt"))
    told = stored(generated(prompts, generate, sleep=sleep))
    if contexts is None:
        empty = "array<struct<marker:string," + ",".join(f"{c}:string" for c in answer.CITED.values()) + ">>"
        image = "array<struct<marker:string,image_id:string,image_url:string,image_alt_text:string,image_caption:string,source_id:string,page:int,content_type:string,status:string>>"
        contexts = told.select("query_id", F.from_json(F.lit("[]"), empty).alias("sources"), F.from_json(F.lit("[]"), image).alias("images"))
    made = answer.answer_rows(told.select("query_id", "text"), contexts, settings.media_base_url)
    return asked.select("query_id", "valid", "too_large").join(told.select("query_id", "code"), "query_id", "left").join(made, "query_id",
        "left").select(
        "query_id", "answer", "citations", "guide", _error(F.col("valid"), F.col("too_large"), F.col("code"), F.col("answer")).alias("error"))


def _error(valid: Column, too_large: Column, code: Column, text: Column) -> Column:
    of = lambda name, status: F.struct(F.lit(name).alias("code"), F.lit(status).alias("status"))
    return (
        F.when(~valid, of("REQUEST_INVALID", 422)).when(too_large, of("REQUEST_TOO_LARGE", 413)).when(code.isNotNull(),
            answer.provider_error(code, "GENERATION_ERROR"))
        .when(text.isNull(), of("ANSWER_INVALID", 503))
    )
