"""Bar-series analytics on Spark: cleaning, resampling, indicators, labels, similarity, models, backtests."""
