"""threadloom: analytics over threaded message corpora, expressed on Spark DataFrames."""
