"""parecer: what drives bad reviews, answered with Spark DataFrames.

``sources``    tables in and out (CSV, Parquet, the star-schema adapters)
``functions``  column expressions and the fixed values they use
``operators``  DataFrame in, DataFrame out; no global session
``plans``      operators put together: the six analysis steps, the query catalog
"""
