"""All queries of the reference's operators over the driver's tables.

Bindings: a knowledge base is a source, a chunk is a document, a question is a benchmark item, a query vector is an embedding.
"""

from quarry.plans import documents, search, state, stored, texts  # noqa: F401
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
