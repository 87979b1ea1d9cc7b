"""Lumetra: news-to-records linkage analytics and training-data operators on Spark DataFrames."""
