"""All queries of the subpackage."""

from __future__ import annotations

from eventgrove.llm import dedup_queries, mix_queries, text_queries, token_queries, vector_queries  # noqa: F401  (importing the modules fills the registry)
from eventgrove.llm.registry import ORACLES, QUERIES  # noqa: F401
