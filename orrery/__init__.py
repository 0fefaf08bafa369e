"""Analytics over orbital catalogues, expressed as Spark DataFrames."""
