"""The corpus pipeline: its stages, its SQL and ``run``, from ``lorespark.llm``."""

from lorespark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
