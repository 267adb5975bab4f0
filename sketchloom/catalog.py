"""All registered queries over the driver's tables and their SQL for DuckDB."""

from .plans import branches, corpora, facets, graphs, prob, sketches, stored, streams, texts, time  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q_bss_matrix"
