"""specdag: a closed, typed analytics specification lowered to Spark DataFrames."""
