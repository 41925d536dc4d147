"""leafmill: document-structure analytics on Spark DataFrames."""
