"""Continuous ingestion, an addition to the batch engine: new files become sections, and changed documents replace themselves."""
