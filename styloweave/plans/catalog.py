"""All registered queries; importing the modules registers them."""

from styloweave.plans import corpus_queries, document_queries, source_queries, stream_queries, style_queries  # noqa: F401
from styloweave.plans.registry import ORACLES, QUERIES  # noqa: F401
