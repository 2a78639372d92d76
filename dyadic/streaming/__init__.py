"""Structured Streaming form of the term-by-term dyad append (SE-3)."""

from dyadic.streaming.terms import append_terms_stream

__all__ = ["append_terms_stream"]
