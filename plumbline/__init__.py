"""Decision-data work on Spark: convert, guard, sample, label, calibrate, score, compare and publish."""
