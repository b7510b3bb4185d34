"""Logs that arrive in pieces."""

from .parse_stream import parse_stream

__all__ = ["parse_stream"]
