"""Radio-emitter observation analytics on Spark DataFrames."""
