"""Collecting, cleaning and classifying short texts as Spark jobs."""
