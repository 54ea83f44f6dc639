"""Analytics over ordered word timelines and time intervals, on Spark DataFrames."""
