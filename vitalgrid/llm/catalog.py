"""All registered corpus queries."""

from vitalgrid.llm import bpe, chat_format, exact_dedup, hard_negatives, id_files, line_dedup, packing, quality, shingle_join, source_mix, suffix_dedup, vector_dedup, whitening  # noqa: F401
from vitalgrid.llm.registry import ORACLES, QUERIES  # noqa: F401
