"""sqlscore: evaluation of SQL corpora and model outputs as Spark DataFrame jobs."""

__version__ = "0.1.0"
