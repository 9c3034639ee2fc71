"""All queries of this package; importing it registers them."""

import tradewind.llm.queries_audit  # noqa: F401
import tradewind.llm.queries_dedup  # noqa: F401
import tradewind.llm.queries_near  # noqa: F401
import tradewind.llm.queries_quality  # noqa: F401
import tradewind.llm.queries_search  # noqa: F401
import tradewind.llm.queries_sensitive  # noqa: F401
import tradewind.llm.queries_spans  # noqa: F401
import tradewind.llm.queries_tokens  # noqa: F401
from tradewind.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
