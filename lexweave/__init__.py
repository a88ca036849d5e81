"""Text segmentation and vocabulary engine on Spark DataFrames."""
