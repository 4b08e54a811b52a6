"""Timeline analytics on Spark: operators for time-stamped records as plain DataFrame functions."""
