"""Typed questions put to a classifier about messages and conversations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Answer types, the yes/no threshold, question keys and answer options.
CHOICE, SCORE, YES_NO = "choice", "score", "noul"
TYPES = (CHOICE, SCORE, YES_NO)
YES_THRESHOLD = 0.5
COVERAGE_KEY = "valence"
BID_KEY = "is_bid"
BID_MET_KEY = "bid_met"


@dataclass(frozen=True)
class Question:
    """One question; what it may be answered with depends on its type.

    A choice names its options in ``criteria``, a score its rungs in ``levels``, and
    a yes/no question (``noul``) needs neither.
    """

    key: str
    type: str
    instructions: str
    criteria: Mapping[str, str] = field(default_factory=dict)
    levels: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"question {self.key!r}: unknown type {self.type!r}")
        if not self.instructions.strip():
            raise ValueError(f"question {self.key!r} has no instructions")
        if self.type == CHOICE and len(self.criteria) < 2:
            raise ValueError(f"choice question {self.key!r} needs two options or more")
        if self.type == SCORE and len(self.levels) < 2:
            raise ValueError(f"score question {self.key!r} needs two levels or more")

    @classmethod
    def from_mapping(cls, key: str, spec: Mapping) -> "Question":
        """From the nested form ``{type, instructions, criteria, levels}``.

        A type outside the closed set is read as a choice.
        """
        kind = str(spec.get("type", CHOICE))
        return cls(
            key=key,
            type=kind if kind in TYPES else CHOICE,
            instructions=str(spec.get("instructions", "")),
            criteria=dict(spec.get("criteria") or {}),
            levels=tuple(spec.get("levels") or ()),
        )

    def identity(self) -> list:
        return [self.key, self.type, self.instructions, dict(self.criteria), list(self.levels)]


def question_set(spec: Mapping[str, Mapping]) -> list[Question]:
    """A caller's own questions, by key."""
    return [Question.from_mapping(key, value) for key, value in spec.items()]


def fingerprint(questions: Sequence[Question]) -> str:
    """Changes with any change to any question, so an edited set is asked again."""
    text = json.dumps([question.identity() for question in questions], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


MESSAGE_QUESTIONS = (
    Question(
        "tone",
        CHOICE,
        "Which tone fits the message best?",
        {
            "affectionate": "tender or loving",
            "friendly": "kind, cheerful or encouraging",
            "casual": "relaxed small talk",
            "frustrated": "irritated or fed up",
            "neutral": "plain information",
        },
    ),
    Question("is_conflict", YES_NO, "Is there an argument or a grievance in the message?"),
)

CONVERSATION_QUESTIONS = (
    Question(
        "relationship_dynamic",
        CHOICE,
        "How do the people in this exchange relate to each other?",
        {
            "close_friends": "familiar, joking, at ease",
            "romantic": "in love or courting",
            "colleagues": "about work, organised",
            "acquaintances": "polite and distant",
        },
    ),
    Question(
        "overall_sentiment",
        CHOICE,
        "What is the mood of the exchange as a whole?",
        {
            "positive": "warm and agreeable",
            "neutral": "practical",
            "tense": "strained or hostile",
        },
    ),
)

ASSESSMENT_QUESTIONS = (
    Question(
        COVERAGE_KEY,
        CHOICE,
        "Does the message carry good, bad or no particular feeling?",
        {
            "positive": "kind, playful or thankful",
            "neutral": "practical, no feeling shown",
            "negative": "hurt, angry, cold or blaming",
        },
    ),
    Question(BID_KEY, YES_NO, "Does the sender seek the other person's attention or reaction?"),
    Question(
        "friction",
        CHOICE,
        "Which friction towards the other person does the message show?",
        {
            "none": "none at all",
            "criticism": "faults the person, not the deed",
            "defensiveness": "wards off blame or blames back",
            "contempt": "mocks or looks down on them",
        },
    ),
    Question("is_repair", YES_NO, "Does the sender apologise or try to calm things down?"),
    Question(
        "sarcasm",
        SCORE,
        "How sarcastic is the message?",
        levels=("sincere", "lightly teasing", "plainly sarcastic", "bitingly sarcastic"),
    ),
    Question(
        "discourse_act",
        CHOICE,
        "What does the message do in the conversation?",
        {
            "statement": "tells or acknowledges something",
            "closed_question": "asks for a fact, or a yes or no",
            "open_question_or_vulnerability": "asks to hear more, or shares something personal",
        },
    ),
)

RESPONSE_QUESTIONS = (
    Question("turns_toward", YES_NO, "Does the response take up what the previous message said?"),
)
