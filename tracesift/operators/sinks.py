"""Delivering batches: each goes out once, is tried again once where that can help, and every event gets a status."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Statuses after which a second try can succeed, and seconds to wait by default and at most.
RETRIED, WAIT_S, MOST_S = (429, 503), 1.0, 60.0

#: What a transport answers: the batch's status, statuses by event (None: none given), seconds to wait (None: not said).
Answer = tuple[int, list[int] | None, float | None]


def deliver(batched: DataFrame, send: Callable[[pd.DataFrame], Answer], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """id, status for each row of ``batched`` (destination, slot, batch, part, id and the data that ``send`` needs).

    Rows of a null part are too large and get 400 unsent. A batch is sent again once after a time-out (TimeoutError) or a status
    in RETRIED, if the wait asked for is under MOST_S. An event without a status of its own gets 500 in a batch that got 200, else
    the batch's. Delivery is at least once: a lost executor's batches are sent again."""
    key = ["destination", "slot", "batch", "part"]

    def attempt(pdf: pd.DataFrame) -> Answer:
        for last in (False, True):
            try:
                status, own, wait = send(pdf)
            except TimeoutError:
                status, own, wait = 504, None, 0.0
            pause = WAIT_S if wait is None else wait
            if last or (status not in RETRIED and status != 504) or not 0 <= pause < MOST_S:
                return status, own, wait
            sleep(pause)
        raise AssertionError

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            groups = [g for _, g in pdf.groupby(key, sort=False, dropna=False)]
            for g in groups[:-1]:
                yield one(g)
            held = groups[-1] if groups else None  # may go on in the next frame
        if held is not None:
            yield one(held)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        if g["part"].isna().all():
            return pd.DataFrame({"id": g["id"], "status": 400})
        status, own, _ = attempt(g)
        statuses = [status] * len(g) if status != 200 else [500 if own is None or i >= len(own) else own[i] for i in range(len(g))]
        return pd.DataFrame({"id": g["id"].to_numpy(), "status": statuses})

    dealt = batched.repartition(*key).sortWithinPartitions(*key, "id")
    return dealt.mapInPandas(run, f"id {dict(batched.dtypes)['id']}, status int")
