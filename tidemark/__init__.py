"""tidemark: causal time-series analytics and backtesting on PySpark."""
