"""duelscope: rating, forecast and upset analytics for paired contests, on Spark DataFrames."""
