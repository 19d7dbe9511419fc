"""The corpus pipeline's stages (see ``loamline.llm.pipeline``)."""

from loamline.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
