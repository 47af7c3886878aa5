"""Imports every operator module, so that its query and SQL twin are registered."""

from cubeloom.llm import alignment, chat, credentials, jaccard, licenses, mixing, neardup, neighbours, packing, quality, squares, tokencount, tokenfile  # noqa: F401
from cubeloom.llm.common import ORACLES, QUERIES  # noqa: F401
