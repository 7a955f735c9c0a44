"""A store of model answers that outlives a call.

Answers are kept by model, question set and state: a folder per model and fingerprint of
the questions, rows ``(state_key, answers)``. States that the store answers are never asked
again, whichever rows they come from; a changed question or criterion has another
fingerprint and asks anew.

States are asked in chunks, and a chunk's answers are committed by Spark's own write before
the next begins. If the model fails, the chunks before stay and the next call asks the rest;
attempts of a task that are not committed leave nothing. Two calls at a time may answer a
state twice; one of the answers is read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from convoscope.operators.questions import Question, fingerprint
from convoscope.session import staged

#: States that one model task takes, so tasks follow what is asked.
STATES_PER_TASK = 1_000


@dataclass(frozen=True)
class AnswerStore:
    """The folder of the store, and the states that are committed together."""

    path: str
    states_per_chunk: int = 1_000_000

    def folder(self, model: str, questions: Sequence[Question]) -> str:
        name = hashlib.sha256(f"{model}\n{fingerprint(questions)}".encode()).hexdigest()
        return f"{self.path.rstrip('/')}/answers={name}"

    def known(self, spark: SparkSession, model: str, questions: Sequence[Question], schema: T.StructType) -> DataFrame | None:
        """Every stored answer of the model to these questions, a state once; None before the first."""
        folder = self.folder(model, questions)
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            return None
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder).dropDuplicates(["state_key"])

    def answers(
        self, states: DataFrame, model: str, questions: Sequence[Question], schema: T.StructType,
        ask: Callable[[DataFrame], DataFrame], tasks: int | None = None,
    ) -> DataFrame:
        """The answer to each of the distinct ``states`` ``(state_key, state)``; ``ask`` gives
        those the store lacks. ``tasks`` per chunk: by default from the number of states."""
        spark = states.sparkSession
        wanted = staged(states, "states")
        before = self.known(spark, model, questions, schema)
        if before is not None:
            before = staged(before.join(wanted.select("state_key"), "state_key", "left_semi"), "known")
            todo = wanted.join(before.select("state_key"), "state_key", "left_anti")
        else:
            todo = wanted
        n = todo.count()
        chunks = max(1, math.ceil(n / self.states_per_chunk))
        tasks = tasks or max(1, math.ceil(n / chunks / STATES_PER_TASK))
        folder, call = self.folder(model, questions), uuid.uuid4().hex
        written = []
        for chunk in range(chunks if n or before is None else 0):
            part = todo.where(F.pmod(F.xxhash64("state_key"), F.lit(chunks)) == chunk)
            written.append(f"{folder}/{call}-{chunk}")
            ask(part.repartition(tasks, "state_key")).write.parquet(written[-1])
        if not written:
            return before
        fresh = spark.read.schema(schema).parquet(*written)
        return fresh if before is None else before.unionByName(fresh)
