"""The corpus pipeline of tallyfold.llm.pipeline: its STAGES, run() and ORACLE_SQL."""

from tallyfold.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
