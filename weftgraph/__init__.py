"""Pattern queries over labelled graphs, compiled to Spark DataFrames."""
