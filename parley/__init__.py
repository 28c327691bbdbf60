"""parley: conversation-memory and document analytics on Spark DataFrames."""
