"""A PySpark engine for time-aligned dialogue transcripts and their evaluation."""
