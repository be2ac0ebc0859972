"""tarnwick: retrieval analytics and training-data preparation as Spark plans.

Every operator is a function from DataFrames to DataFrames.  Batches of queries
are keyed by ``qid``; a single question is a batch of one.
"""

__version__ = "0.1.0"
