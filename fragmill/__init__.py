"""An evidence-carrying retrieval engine over Spark DataFrames."""
