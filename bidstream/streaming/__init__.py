"""Structured Streaming forms of the queries, replay of finite logs, and replay metrics."""

from bidstream.streaming.forms import FORMS, Form
from bidstream.streaming.run import compact, result, start
from bidstream.streaming.settings import configure_streaming

__all__ = ["FORMS", "Form", "compact", "result", "start", "configure_streaming"]
