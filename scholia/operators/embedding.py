"""Vectors of texts by a function that the user passes."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.calls import client, timed

Embedder = Callable[[list[str]], list[list[float]]]
#: Texts that the function gets at once, calls at a time and seconds that one may take.
BATCH, AT_ONCE, SECONDS = 64, 4, 60.0


def letter_shares(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often each letter occurs, scaled to length one."""
    out = []
    for text in texts:
        # In UTF-8 a letter's byte is nothing else.
        counts = np.bincount(np.frombuffer(text.lower().encode(errors="replace"), np.uint8), minlength=256)[ord("a") : ord("z") + 1].tolist()
        size = math.sqrt(sum(n * n for n in counts))
        out.append([n / size if size else 0.0 for n in counts])
    return out


def embed(
    df: DataFrame, function: Embedder = letter_shares, text: str = "text", name: str = "embedding", error: str = "embedding_error",
    connect: Callable[[], Embedder] | None = None, seconds: float = SECONDS, at_once: int = AT_ONCE,
) -> DataFrame:
    """Adds the vectors of a text column, and why there is none.

    The function is called in tasks, with BATCH texts and `at_once` calls at a time; a
    null text is an empty one. connect: makes the function, once a worker. Where a
    call fails its texts are tried one by one, so that one bad text costs its own
    vector only; a call that takes longer than `seconds` isn't tried again.
    """
    batches = df.select(*[c for c in df.columns if c not in (name, error)])
    (column,) = [c for c in batches.columns if c == text]
    names = batches.columns
    schema = batches.withColumns({name: F.lit(None).cast("array<double>"), error: F.lit(None).cast("string")}).schema
    own = uuid.uuid4().hex

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = client(own, connect) if connect else function

        def call(texts: list[str]) -> list[list[float]]:
            vectors = [[float(x) for x in v] for v in model(texts)]
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors of {len(texts)} texts")
            return vectors

        for f in frames:
            texts = ["" if t is None else t for t in f.column(column).to_pylist()]
            vectors: list[list[float] | None] = [None] * len(texts)
            errors: list[str | None] = [None] * len(texts)
            starts = range(0, len(texts), BATCH)
            again = []
            for i, (found, failed) in zip(starts, timed(call, [texts[i : i + BATCH] for i in starts], seconds, at_once), strict=True):
                here = range(i, min(i + BATCH, len(texts)))
                for j in here:
                    vectors[j], errors[j] = (None, failed) if failed is not None else (found[j - i], None)
                again += here if failed is not None and len(here) > 1 and not failed.startswith("timed out") else []
            for j, (found, failed) in zip(again, timed(call, [[texts[j]] for j in again], seconds, at_once), strict=True):
                vectors[j], errors[j] = (None, failed) if failed is not None else (found[0], None)
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[*names, name, error])

    return batches.mapInArrow(run, schema)
