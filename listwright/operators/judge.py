"""A language model as a judge of the best listings. The model is a function handed in; nothing here calls a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import json_paths as J
from listwright.functions import text as T
from listwright.operators.rank import judge_candidates

DESCRIPTION_CHARS = 1500


def listing_prompt() -> Column:
    """What the judge is told of a listing."""
    line = lambda head, value: F.concat(F.lit(f"  {head}: "), F.coalesce(value, F.lit("?")))
    return F.concat_ws(
        "\n",
        F.lit("Listing:"),
        line("Title", F.col("title")),
        line("Company", F.col("company")),
        line("Location", F.col("location")),
        line("Remote", F.col("remote_mode")),
        line("Posted", F.date_format("posted_at", "yyyy-MM-dd")),
        line("Description", T.truncate(F.coalesce("description", F.lit("")), DESCRIPTION_CHARS)),
    )


def chat(system: str, prompts: Column, load: Callable[[], Callable[[str, str], str]]) -> Column:
    """Answers of a model to prompts, null where it fails. ``load`` runs once in each task and gives the model."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:
            model = None  # an unreachable model leaves every row unjudged
        for batch in batches:
            yield pd.Series([_answer(model, system, p) for p in batch], dtype=object)

    return ask(prompts)


def _answer(model, system: str, prompt: str):
    try:
        return model(system, prompt) if model else None
    except Exception:
        return None  # the row stays unjudged


def judge(scored: DataFrame, top_n: int, system: str, load, seq: str = "seq") -> DataFrame:
    """(``seq``, ``verdict_score``, ``verdict_reason``) for the best ``top_n`` rows that got an answer. The best are
    chosen before the model is called."""
    chosen = judge_candidates(scored, top_n, seq).select(seq, listing_prompt().alias("prompt"))
    answers = chosen.select(seq, chat(system, F.col("prompt"), load).alias("answer"))
    score, reason = J.verdict(F.col("answer"))
    return answers.select(seq, score.alias("verdict_score"), reason.alias("verdict_reason")).where("verdict_score is not null")
