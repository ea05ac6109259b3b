"""Market research jobs on Spark: DataFrame in, DataFrame out, over one long (Ticker, Date) table."""
