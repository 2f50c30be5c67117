"""The corpus pipeline: documents without toxic texts and near copies, secrets blanked out, sources mixed, encoded."""

from cairn.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
