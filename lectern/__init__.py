"""Turns technical documents into clean, ordered, speakable text, on Spark DataFrames."""
