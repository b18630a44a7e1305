"""subsieve: subset matching over large collections of tag sets, on Spark DataFrames."""
