"""Resumable imports as streams: which pages are done, which failed, and when to give up, kept as state by document.

Page results arrive as rows (doc_id, page, words, error, at). A failed page is never done; five failures in a row, where
a success without words neither helps nor hurts, stop the document. A run that is started again goes on from its
checkpoint, and a document's state outlives any executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ABORT = 5
STATE = "done array<int>, failed array<int>, consecutive int, aborted boolean"
OUTPUT = "doc_id string, done array<int>, failed array<int>, consecutive int, aborted boolean"


def fold_pages(state: tuple | None, pages: list[tuple[int, int, str | None]]) -> tuple[list[int], list[int], int, bool]:
    """State after more pages (page, words, error), in their order; pages after the end are not looked at."""
    done, failed, consecutive, aborted = state or ([], [], 0, False)
    done, failed = set(done), set(failed)
    for page, words, error in pages:
        if aborted:
            break
        if error:
            consecutive += 1
            failed.add(page)
            aborted = consecutive >= ABORT
        else:
            consecutive = 0 if words > 0 else consecutive
            done.add(page)
            failed.discard(page)
    return sorted(done), sorted(failed - done), consecutive, aborted


def progress(results: DataFrame) -> DataFrame:
    """A streaming frame of each document's state whenever pages have come in."""

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "page"])
        old = state.get if state.exists else None
        pages = [(int(r.page), int(r.words), r.error if isinstance(r.error, str) else None) for r in rows.itertuples()]
        new = fold_pages(old, pages)
        state.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["doc_id", "done", "failed", "consecutive", "aborted"])

    return results.groupBy("doc_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def pending(scan: DataFrame, done: DataFrame, retry: bool = False) -> DataFrame:
    """Pages (doc_id, page) still to be read: all that need recognition less those done; failed ones (error) come back on retry."""
    finished = done.where("error is null") if retry else done
    return scan.where("method = 'ocr'").select("doc_id", "page").join(finished.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def share_done(stage: str, done, total):
    """Progress in per cent of a whole import: 0-5 classifying, 5-80 recognising, 80-88 extracting, 88-100 analysing."""
    low, high = {"classify": (0, 5), "ocr": (5, 80), "extract": (80, 88), "analyse": (88, 100)}[stage]
    part = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    return F.floor(low + (high - low) * part + F.lit(0.5)).cast("int")


def write_partitions(batch: DataFrame, path: str) -> None:
    """foreachBatch sink: documents of a batch replace their own partitions and no others, so repeating a batch changes nothing."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)
