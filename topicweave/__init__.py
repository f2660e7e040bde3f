"""topicweave: topic-aware corpus preparation and loss-driven topic reweighting on Spark.

Every operator takes DataFrames and returns a DataFrame; no operator runs an action
except where noted (model fitting, size checks of broadcast sides).
"""

__version__ = "0.1.0"
