"""Calls of outer services (models, search, fetching) for the rows of a table: bounded, retried, each with one outcome.

Rows of a partition are called by a bounded number of threads at a time. A failure whose class may pass (``again``, rules
of error_class) is tried again after a wait that doubles; any other, and the last try, is the row's outcome. Outcomes are
commits of a store keyed by the row, so a run that broke off, or is repeated, calls only what has no outcome, and rows
that were refused are a table that can be looked at, corrected and opened again.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.classify import FINAL, PASSING
from lexispark.operators.store import BUCKETS, BucketStore

OUTCOME = "id long, status string, attempts int, reply string, error string"
#: Calls of a partition at a time, tries, and seconds before the second one.
PARALLEL, TRIES, WAIT = 8, 3, 1.0


def passes(error: Exception) -> bool:
    """As ``is_retryable`` says of a message: final marks win over passing ones; time-outs and lost connections pass."""
    text = str(error).lower()
    return not any(m in text for m in FINAL) and (isinstance(error, (TimeoutError, ConnectionError)) or any(m in text for m in PASSING))


def outcome_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, path, OUTCOME, ("id",), buckets)


def one(call: Callable[[str], str], value: str, tries: int, wait: float, again: Callable[[Exception], bool], sleep: Callable[[float], None]) -> tuple[str, int, str | None, str | None]:
    """status (done or refused), attempts, reply and error of one row. An empty reply counts as an error that may pass."""
    for n in range(1, tries + 1):
        try:
            reply = call(value)
            if reply is not None and reply.strip():
                return "done", n, reply, None
            error, repeat = "empty reply", True
        except Exception as e:
            error, repeat = f"{type(e).__name__}: {e}", again(e)
        if not repeat or n == tries:
            return "refused", n, None, error
        # Up to half as long again, so that rows that failed together do not come back together.
        sleep(wait * 2 ** (n - 1) * (1 + random.random() / 2))
    raise ValueError("at least one try")


def called(rows: DataFrame, call: Callable[[str], str], parallel: int = PARALLEL, tries: int = TRIES, wait: float = WAIT, again: Callable[[Exception], bool] = passes) -> DataFrame:
    """OUTCOME of each of ``rows(id, input)``. At most ``parallel`` calls of a partition are under way, and two Arrow batches
    of its rows are held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for frame in frames:
                found = pool.map(lambda v: one(call, v, tries, wait, again, time.sleep), frame["input"])
                out = pd.DataFrame(list(found), columns=["status", "attempts", "reply", "error"])
                yield out.assign(id=frame["id"].to_numpy())[["id", "status", "attempts", "reply", "error"]]

    return rows.select("id", "input").mapInPandas(run, OUTCOME)


def call_open(store: BucketStore, rows: DataFrame, call: Callable[[str], str], reopen: bool = False, batches: int = 8, before: Callable[[int], None] = lambda batch: None, **how) -> int:
    """Calls what has no outcome in ``store`` (with ``reopen``, what was refused too), a group of buckets a commit; returns
    the number of commits. Ids are unique and not null."""
    done = 0
    for b in range(batches):
        before(b)
        mine = rows.withColumn("_bucket", store.bucket()).filter(F.col("_bucket") % batches == b).drop("_bucket")
        held = store.rows(buckets={k for k in range(store.buckets) if k % batches == b})
        settled = held.filter("status = 'done'") if reopen else held
        open_ = mine.join(settled.select("id"), "id", "left_anti")
        if open_.isEmpty():
            continue
        number = store.applied("calls") + 1

        def merge(old: DataFrame, open_=open_) -> DataFrame:
            return old.join(open_.select("id"), "id", "left_anti").unionByName(called(open_, call, **how))

        done += store.commit("calls", number, open_, merge)
    return done
