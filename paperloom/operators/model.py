"""Calls to a model endpoint from tasks: retries, backoff, and what came of each call.

The endpoint is a function of one text. Calls run in the task that holds the
row, in order, so a limit per task times the number of tasks is the load. An
error that may pass is retried with doubling waits; a lost executor repeats only
its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ATTEMPTS = 4
FIRST_WAIT, LONGEST_WAIT = 1.0, 8.0
#: Answers that may pass on a later try (fixed values).
PASSING = frozenset({408, 425, 429, 500, 502, 503, 504})


class CallError(Exception):
    """A failed call with the endpoint's status code."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message)
        self.status = status


def call(endpoint: Callable[[str], str], text: str, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, int | None]:
    """(answer, attempts, last status): an error that can't pass ends the call at once."""
    wait, status = FIRST_WAIT, None
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return endpoint(text), attempt, None
        except CallError as e:
            status = e.status
            if status not in PASSING or attempt == ATTEMPTS:
                return None, attempt, status
        sleep(wait)
        wait = min(2 * wait, LONGEST_WAIT)
    return None, ATTEMPTS, status


def answers(df: DataFrame, id_col: str, text_col: str, endpoint: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, answer, attempts, status) of each row; null and blank texts aren't sent and keep their text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, text in zip(pdf.id, pdf.text, strict=True):
                sent = isinstance(text, str) and text.strip()
                rows.append((key, *(call(endpoint, text, sleep) if sent else (text if isinstance(text, str) else None, 0, None))))
            yield pd.DataFrame(rows, columns=["id", "answer", "attempts", "status"]).astype({"attempts": "Int64", "status": "Int64"})

    return df.selectExpr(f"CAST({id_col} AS BIGINT) AS id", f"CAST({text_col} AS STRING) AS text").mapInPandas(run, "id long, answer string, attempts long, status long")
