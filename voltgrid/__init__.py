"""EV-charging demand and placement analytics on Spark DataFrames."""
