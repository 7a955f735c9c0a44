"""Conversation analytics on Spark: behavioural profiles of many chats at once."""

from convoscope.params import Params

__all__ = ["Params"]
