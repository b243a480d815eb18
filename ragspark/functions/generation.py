"""Batch text generation through a function of the caller.

A generator is made once per task by a factory (where a model would be loaded) and maps a
series of prompts to a series of texts. Answers without any model are read out of the retrieved
texts by ``plans.reading``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallel, pieces_of, sized

# Characters of prompts that one task is given.
TASK_CHARS = 4_000_000

Generator = Callable[[pd.Series], pd.Series]


@dataclass(frozen=True)
class Sampling:
    """Settings handed to a generator factory. Those of the reference's model."""

    temperature: float = 0.75
    max_tokens: int = 2000
    top_p: float = 1.0
    context_tokens: int = 8192
    extra: dict = field(default_factory=dict)


ANSWERING = Sampling()
QUESTION_WRITING = Sampling(context_tokens=16384)


Factory = Callable[[Sampling], Generator]
#: Name of the factory for rows whose variant has none of its own.
DEFAULT_MODEL = "default"


def generate(rows: DataFrame, factory: Factory | dict[str, Factory], prompt: str = "prompt",
             out: str = "output", sampling: Sampling = ANSWERING, partitions: int | None = None,
             variant: str | None = None) -> DataFrame:
    """Add column ``out``; ``prompt`` is dropped. Equal prompts are generated once.

    ``factory`` makes the generator of a task; several under names are chosen by the column
    ``variant``, those without a name of their own by ``default``. Prompts are few bytes next to the
    work they cause, so the different ones are dealt to ``partitions`` tasks (by default one a core and
    more, so that a task holds at most ``TASK_CHARS`` characters of prompts, counted), each batch going to its model.
    What was generated is kept in the shared folder: it is not generated twice.
    """
    models = factory if isinstance(factory, dict) else {DEFAULT_MODEL: factory}
    chosen = F.lit(DEFAULT_MODEL)
    if variant is not None and len(models) > 1:
        chosen = F.when(F.col(variant).isin([m for m in models if m != DEFAULT_MODEL]), F.col(variant)).otherwise(DEFAULT_MODEL)
    spark, keep = rows.sparkSession, [c for c in rows.columns if c != prompt]
    keyed = rows.withColumn("_model", chosen).withColumn("_key", F.xxhash64("_model", prompt))
    distinct = keyed.select("_model", "_key", F.col(prompt).alias("_prompt")).distinct()
    if partitions is None:
        chars = distinct.agg(F.coalesce(F.sum(F.length("_prompt").cast("long")), F.lit(0)).alias("n")).first()["n"]
        partitions = max(parallel(spark), pieces_of(chars, TASK_CHARS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Generator] = {}
        for batch in batches:
            for name, part in batch.groupby("_model", sort=True):
                if name not in made:
                    made[name] = models[name](sampling)
                yield pd.DataFrame({"_model": name, "_key": part["_key"].to_numpy(), "_prompt": part["_prompt"].to_numpy(),
                                    "_text": made[name](part["_prompt"]).to_numpy()})

    written = cut(distinct.repartition(partitions, "_key")
                  .mapInPandas(run, "_model string, _key long, _prompt string, _text string"))
    # a prompt that many rows share is one row on this side; a null prompt meets its own answer too
    same = keyed[prompt].eqNullSafe(written["_prompt"]) & (keyed["_key"] == written["_key"]) & (keyed["_model"] == written["_model"])
    return keyed.join(sized(written, ["_prompt", "_text"]), same, "left").select(*[keyed[c] for c in keep], F.col("_text").alias(out))
