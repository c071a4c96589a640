"""A batched call of an outside service for each row, such as a bundle validator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: takes texts, gives as many answers in the same order; is sent to executors, so it must be importable or picklable there
Backend = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Policy:
    batch_rows: int = 64
    #: seconds for one call
    timeout: float = 60.0
    #: further tries of a call that failed or was late, and the seconds before the first of them (doubled each time)
    retries: int = 2
    pause: float = 0.5


def answers(texts: list[str], backend: Backend, policy: Policy, pool: ThreadPoolExecutor) -> Iterator[tuple[str | None, str | None, int]]:
    """(answer, error, calls) for each text, in order.

    A batch that fails for good is halved until single texts are left: a text that the
    backend can't take costs its neighbours some calls, not their answers.
    """
    fault, calls = "", 0
    for attempt in range(policy.retries + 1):
        if attempt:
            time.sleep(policy.pause * 2 ** (attempt - 1))
        calls += 1
        try:
            got = pool.submit(backend, texts).result(timeout=policy.timeout)
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} answers to {len(texts)} texts")
        except TooLate:
            fault = f"no answer within {policy.timeout} s"
        except Exception as e:  # noqa: BLE001  whatever the backend raises becomes a row's error
            fault = f"{type(e).__name__}: {e}"
        else:
            yield from ((str(a), None, calls) for a in got)
            return
    if len(texts) == 1:
        yield None, fault, calls
        return
    middle = len(texts) // 2
    for part in (texts[:middle], texts[middle:]):
        yield from ((a, e, calls + n) for a, e, n in answers(part, backend, policy, pool))


def called(rows: DataFrame, id_column: str, text_column: str, backend: Backend, policy: Policy = Policy()) -> DataFrame:
    """id, answer, error, calls: one row for each row of ``rows``; either answer or error is null.

    A null text is an error without a call. Rows go out in batches of an executor's
    task, so memory holds one batch; as many calls run at once as there are tasks. Spark
    may run a task again, so the backend should not mind a repeated text.
    """
    kind = dict(rows.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = ThreadPoolExecutor(max_workers=4)  # a late call keeps its thread until it ends
        try:
            for batch in batches:
                for at in range(0, len(batch), policy.batch_rows):
                    part = batch.slice(at, policy.batch_rows)
                    texts = part.column(1).to_pylist()
                    known = iter(answers([t for t in texts if t is not None], backend, policy, pool) if any(t is not None for t in texts) else ())
                    got = [(None, "no text", 0) if t is None else next(known) for t in texts]
                    columns = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], [id_column, "answer", "error", "calls"])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return rows.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, answer string, error string, calls int")
