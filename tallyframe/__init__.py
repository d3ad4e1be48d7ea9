"""tallyframe: flat-file quality, reconciliation, profiling, synthesis and corpus jobs on Spark DataFrames."""
