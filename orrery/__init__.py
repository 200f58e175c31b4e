"""A star-schema analytics engine on Spark, with operators for training data in ``orrery.llm``."""
