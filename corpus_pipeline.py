"""A training corpus from raw documents: quality, exact and near copies, benchmark leaks, source mix."""

from graphloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
