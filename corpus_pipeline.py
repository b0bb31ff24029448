"""Corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, packing. The stages' code is in tallyseal.llm.pipeline, so that a shipped package has it."""

from tallyseal.llm.pipeline import ORACLE_SQL, STAGES, near_duplicates, pack, quality, run, substrings

__all__ = ["ORACLE_SQL", "STAGES", "near_duplicates", "pack", "quality", "run", "substrings"]
