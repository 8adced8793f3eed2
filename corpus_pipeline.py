"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next. See lodestone.llm.stages."""

from lodestone.llm.stages import ORACLE_SQL, STAGES, near_duplicates, packing, quality, repeated_passages, run, toxicity

__all__ = ["ORACLE_SQL", "STAGES", "near_duplicates", "packing", "quality", "repeated_passages", "run", "toxicity"]
