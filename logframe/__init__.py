"""logframe: log lines and text tables analysed as Spark DataFrames."""
