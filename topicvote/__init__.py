"""Iterative topic coding of document corpora on Spark."""

from topicvote.session import get_session

__all__ = ["get_session"]
