"""All queries of the training-data operators; importing this module fills the registry."""

from dealweave.llm import chat_format, exact_dedup, fingerprints, language, middle, nearest, packing, pieces, sharding, simhash, suffixes, toxicity, variants  # noqa: F401
from dealweave.llm.registry import ORACLES, QUERIES  # noqa: F401
