"""Classifiers that answer questions about a state.

A classifier is a small picklable value. On a worker ``open()`` returns a function
from a list of states and the questions to a list of answers, one mapping per state
from question key to a raw answer: ``{"choice": key}``, ``{"score": number}`` or
``{"noul": probability}``, each with optional ``confidence`` and ``probabilities``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from convoscope.operators.questions import CHOICE, SCORE, YES_NO, Question

State = Mapping[str, Any]
Answers = Mapping[str, Mapping[str, Any]]
Predictor = Callable[[Sequence[State], Sequence[Question]], list[Answers]]


class Classifier(Protocol):
    #: Identifies the model and its weights; workers load one copy per name.
    name: str

    def open(self) -> Predictor: ...


@runtime_checkable
class FrameClassifier(Protocol):
    """A model that Spark itself runs, without a Python worker.

    ``answer_states`` takes rows ``(state_key, state)``, the state as JSON, and returns
    ``(state_key, answers)``: one struct per question with ``question_key,
    decision_type, choice, number, confidence, probabilities``.
    """

    name: str

    def answer_states(self, states: DataFrame, questions: Sequence[Question]) -> DataFrame: ...


@dataclass(frozen=True)
class FirstOption:
    """Answers with the first option, yes, or the middle level, unless told otherwise."""

    forced: Mapping[str, Any] = field(default_factory=dict)
    name: str = "first-option"

    def _answer(self, question: Question) -> dict[str, Any]:
        if question.type == CHOICE:
            value = self.forced.get(question.key, next(iter(question.criteria)))
            return {"choice": value, "confidence": 1.0, "probabilities": {value: 1.0}}
        if question.type == SCORE:
            return {"score": self.forced.get(question.key, len(question.levels) // 2), "confidence": 1.0}
        return {"noul": float(self.forced.get(question.key, 1.0)), "confidence": 1.0}

    def open(self) -> Predictor:
        def predict(states: Sequence[State], questions: Sequence[Question]) -> list[Answers]:
            return [{q.key: self._answer(q) for q in questions} for _ in states]

        return predict


@dataclass(frozen=True)
class LengthRule:
    """A deterministic rule on the length of the state's texts, for checks against SQL.

    With n characters in all text values: option or level ``n mod count``; yes with
    probability ``(n mod 10) / 10``.
    """

    name: str = "length-rule"

    def open(self) -> Predictor:
        def answer(length: int, question: Question) -> dict[str, Any]:
            if question.type == CHOICE:
                options = list(question.criteria)
                return {"choice": options[length % len(options)], "confidence": 0.75}
            if question.type == SCORE:
                return {"score": length % len(question.levels), "confidence": 0.5}
            return {"noul": length % 10 / 10, "confidence": 0.25}

        def predict(states: Sequence[State], questions: Sequence[Question]) -> list[Answers]:
            lengths = [
                sum(len(value) for key, value in state.items() if isinstance(value, str) and key != "sender")
                for state in states
            ]
            return [{q.key: answer(length, q) for q in questions} for length in lengths]

        return predict


# --- a trainable yes/no model on Spark ML --------------------------------------------


def train_text_classifier(labelled: DataFrame, features: int = 1 << 16) -> PipelineModel:
    """Fit word weights for one yes/no question on ``text`` and ``label`` (0 or 1)."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
            IDF(inputCol="_counts", outputCol="features"),
            LogisticRegression(labelCol="label", regParam=0.01, maxIter=20),
        ]
    ).fit(labelled.filter(F.length("text") > 0))


def predict_yes(model: PipelineModel, texts: DataFrame) -> DataFrame:
    """Add ``probability`` of yes; runs in the JVM, without a Python worker."""
    scored = model.transform(texts.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.withColumn("_p", vector_to_array("probability")[1]).select(
        *texts.columns, F.col("_p").alias("probability")
    )


@dataclass(frozen=True)
class WordWeights:
    """Trained models as a classifier: one per yes/no question, by question key.

    Each reads the state's field ``text``; a question without a model is an error.
    """

    models: Mapping[str, PipelineModel]
    name: str = "word-weights"
    text: str = "text"

    def answer_states(self, states: DataFrame, questions: Sequence[Question]) -> DataFrame:
        unknown = [q.key for q in questions if q.key not in self.models or q.type != YES_NO]
        if unknown:
            raise ValueError(f"no yes/no model for {', '.join(unknown)}")
        rows = states.select("state_key", F.get_json_object("state", f"$.{self.text}").alias("text"))
        answers = []
        for place, question in enumerate(questions):
            rows = predict_yes(self.models[question.key], rows).withColumnRenamed("probability", f"_yes_{place}")
            yes = F.col(f"_yes_{place}")
            answers.append(
                F.struct(
                    F.lit(question.key).alias("question_key"),
                    F.lit(question.type).alias("decision_type"),
                    F.lit(None).cast("string").alias("choice"),
                    yes.alias("number"),
                    F.greatest(yes, 1 - yes).alias("confidence"),
                    F.lit(None).cast("map<string,double>").alias("probabilities"),
                )
            )
        return rows.select("state_key", F.array(*answers).alias("answers"))
