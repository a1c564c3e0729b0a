"""Program-fact and trace analytics on Spark DataFrames."""
