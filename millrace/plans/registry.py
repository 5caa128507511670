"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import q_index, q_rest, q_search, q_stream, q_text, q_vectors  # noqa: F401  (q_index, q_stream and q_vectors add to the queries of q_search)

QUERIES = q_text.Q | q_search.Q | q_rest.Q
ORACLES = q_text.O | q_search.O | q_rest.O
