"""The subpackage's queries, one module each; importing this one registers them all."""

from filmloom.llm import q_alignment, q_decontamination, q_lexical, q_licenses, q_line_dedup, q_lm, q_mixing, q_ngram_join, q_packing, q_secrets, q_token_counts, q_toxicity, q_vptree  # noqa: F401
from filmloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
