"""loomspark: a Spark-first engine for code graphs, transcripts, experiments and training-data preparation."""

__version__ = "0.1.0"
