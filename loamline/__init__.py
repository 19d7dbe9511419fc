"""loamline: DataFrame-in, DataFrame-out operators for corpora, runs and filings on Spark."""
