"""Hooks for models: encoders, tokenizers and generators are passed in as functions.

A factory is called once a Python worker and returns the function proper, so a
model is loaded once and used for many Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16


def encoder(factory: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Column function text -> array<float> from a factory of batch encoders; null texts give null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for texts in batches:
            known = texts.notna()
            vectors = encode(texts[known].tolist()) if known.any() else []
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            for i, v in zip(texts.index[known], vectors):
                out[i] = [float(x) for x in v]
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def generate(prompts: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], *, key: str = "query_id", text: str = "user") -> DataFrame:
    """key, generated_text from a factory of batch generators."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(frames):
        produce = factory()
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "generated_text": produce(frame[text].tolist())})

    return prompts.select(key, text).mapInPandas(run, f"`{key}` {kind}, generated_text string")


def bag_of_hashes(text: Column, buckets: int = BUCKETS) -> Column:
    """Stand-in encoder on the JVM: counts of the lower-cased words by sha256 modulo the buckets."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    # The last hex digit decides modulo 16; two decide modulo any divisor of 256.
    slots = F.transform(words, lambda w: F.conv(F.right(F.sha2(w, 256), F.lit(2)), 16, 10).cast("int") % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(slots, lambda s: s == b)).cast("float"))
