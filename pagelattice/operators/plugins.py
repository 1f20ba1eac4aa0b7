"""Places for models: summaries and embeddings from any callable, made once per worker process and applied in batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..options import BATCH, Options


def with_summaries(tabs: DataFrame, make: Callable[[], Callable[[str], str]] | None, options: Options = BATCH) -> DataFrame:
    """tabs (id, title, body) with summary, summary_source and error: ``make()`` gives summarize(prompt); a failure falls back to the first sentences and is noted as
    summary_failed. Without a model every summary is the fallback."""
    body = text.truncate_words(F.coalesce("body", F.lit("")), options.max_chars)
    fallback = text.fallback_summary(body, options.summary_sentences)
    if make is None:
        return tabs.withColumns({"summary": fallback, "summary_source": F.lit("fallback"), "error": F.lit(None).cast("string")})
    asked = tabs.where("id is not null").select("id", text.prompt(F.col("title"), body).alias("prompt"))

    def run(batches):
        summarize = make()
        for batch in batches:
            values, errors = [], []
            for p in batch["prompt"]:
                try:
                    values.append((summarize(p) or "").strip() or None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 — any failure of the model is that row's error
                    values.append(None)
                    errors.append(f"summary_failed: {e}")
            yield pd.DataFrame({"id": batch["id"], "_summary": values, "error": errors})

    made = asked.mapInPandas(run, "id long, _summary string, error string")
    out = tabs.drop("error").join(made, "id", "left")
    source = F.when(F.col("_summary").isNotNull(), "llm").otherwise("fallback")
    return out.withColumns({"summary": F.coalesce("_summary", fallback), "summary_source": source}).drop("_summary")


def with_embeddings(tabs: DataFrame, make: Callable[[], Callable[[list[str]], list]], options: Options = BATCH) -> DataFrame:
    """tabs (id, title, summary, domain, text_excerpt, embedding) with embedding and embedding_error: only tabs without a vector and with some text are sent to ``make()``'s
    embed(texts); vectors already there (from a cache) stay."""
    sent = text.truncate_words(text.embedding_text(F.col("title"), F.col("summary"), F.col("domain"), F.col("text_excerpt")), options.embed_max_chars)
    asked = tabs.where("id is not null and embedding is null").select("id", sent.alias("t")).where("t <> ''")

    def run(batches):
        embed = make()
        for batch in batches:
            try:
                vectors, error = [list(map(float, v)) for v in embed(list(batch["t"]))], None
            except Exception as e:  # noqa: BLE001
                vectors, error = [None] * len(batch), str(e)
            yield pd.DataFrame({"id": batch["id"], "_vector": vectors, "embedding_error": [error] * len(batch)})

    made = asked.mapInPandas(run, "id long, _vector array<double>, embedding_error string")
    return tabs.drop("embedding_error").join(made, "id", "left").withColumn("embedding", F.coalesce("embedding", "_vector")).drop("_vector")
