"""Registered queries of the llm operators and their SQL."""

from __future__ import annotations

from brackenfold.llm import queries_text, queries_vectors

MODULES = [queries_text, queries_vectors]
