"""A pipeline over the documents table: five stages, in order, each on all that the one before it kept."""

from corploom.llm.stages import STAGES, classified, decontaminated, deduplicated, run, tokenized, unrepeated

__all__ = ["ORACLE_SQL", "STAGES", "classified", "decontaminated", "deduplicated", "run", "tokenized", "unrepeated"]

ORACLE_SQL = None  # learned weights, alignment and BPE have no SQL form
