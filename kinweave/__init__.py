"""Record linkage and golden-record building on Spark DataFrames."""
