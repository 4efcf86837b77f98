"""cadence: a Spark-first engine for keyed, irregularly sampled time series and the relational work around them."""
