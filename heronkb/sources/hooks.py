"""Injected external models, run over Arrow batches on the executors."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Hooks

LOG = logging.getLogger(__name__)

def _called(model: Callable[[Sequence[str]], list[str]], texts: list[str], timeout_s: float | None) -> list[str]:
    """One call, given up after a time; its thread doesn't hold up the worker's exit."""
    done: list = []

    def work() -> None:
        try:
            done.append((list(model(texts)), None))
        except Exception as e:  # noqa: BLE001  told to the caller
            done.append((None, e))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout_s)
    if not done:
        raise TimeoutError(f"no answer after {timeout_s} s")
    if done[0][1] is not None:
        raise done[0][1]
    if len(done[0][0]) != len(texts):
        raise ValueError(f"{len(done[0][0])} answers for {len(texts)} texts")
    return done[0][0]


def asked(model: Callable[[Sequence[str]], list[str]], texts: list[str], attempts: int, wait_s: float, timeout_s: float | None, before: Callable[[], None] = lambda: None) -> list[str | None]:
    """The model's answers, or nulls once every attempt has failed, taken too long, or answered for another number of texts.

    Failures are logged; ``before`` is called ahead of each attempt.
    """
    for n in range(max(attempts, 1)):
        if n:
            time.sleep(wait_s * 2 ** (n - 1))
        before()
        try:
            return _called(model, texts, timeout_s)
        except Exception as e:  # noqa: BLE001  any failure of the model leaves the text as it was
            LOG.warning("model call failed, attempt %d of %d: %s", n + 1, attempts, e)
    return [None] * len(texts)


class Pace:
    """Least time between the calls of a task."""

    def __init__(self, pause_s: float) -> None:
        self.pause_s, self.last = pause_s, -pause_s

    def __call__(self) -> None:
        time.sleep(max(0.0, self.last + self.pause_s - time.monotonic()))
        self.last = time.monotonic()


def rewritten(rows: DataFrame, source: str, target: str, hooks: Hooks, model: Callable[[Sequence[str]], list[str]] | None = None, only: str | None = None) -> DataFrame:
    """Adds the answer of a language model (``hooks.rewrite`` by default) to a text column; null where it fails, so
    that callers keep the source. With ``only``, rows where that column isn't true are not sent.

    ``least_interval_s`` is the least time between two calls of one task. With ``calls_per_second``, rows are dealt to ``callers`` tasks, each
    of which may use its share: all together, retries too, stay under the limit, on any number of executors.
    """
    model, pause, size = model or hooks.rewrite, hooks.least_interval_s, max(1, hooks.texts_per_call)
    if hooks.calls_per_second:
        rows, pause = rows.repartition(hooks.callers), max(pause, hooks.callers / hooks.calls_per_second)
    bounds = hooks.attempts, hooks.retry_wait_s, hooks.timeout_s
    shape = T.StructType([*rows.schema.fields, T.StructField(target, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(pause)
        for batch in batches:
            sent = batch[only].fillna(False).astype(bool) if only else pd.Series(True, batch.index)
            answers = pd.Series([None] * len(batch), batch.index, dtype=object)
            texts = batch[source][sent].fillna("").tolist()
            if texts:
                answers[sent] = [x for at in range(0, len(texts), size) for x in asked(model, texts[at : at + size], *bounds, before=pace)]
            yield batch.assign(**{target: answers})

    return rows.mapInPandas(run, shape)


def metadata(docs: DataFrame, answer: str | None = None) -> DataFrame:
    """Adds title and summary: from a model's JSON answer, or the file name without its ending."""
    stem = F.when(F.col("filename").contains("."), F.regexp_replace("filename", r"\.[^.]*$", "")).otherwise(F.col("filename"))
    if answer is None:
        return docs.withColumns({"title": stem, "summary": F.lit("")})
    json = F.regexp_extract(F.col(answer), r"(?s)\{.*\}", 0)
    title = F.get_json_object(json, "$.title")
    return docs.withColumns({"title": F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(stem), "summary": F.coalesce(F.get_json_object(json, "$.summary"), F.lit(""))})
