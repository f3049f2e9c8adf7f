"""Riverstone: summarising and clustering large point sets and streams on Spark.

Points are reduced to small weighted coresets by distance-squared sampling, coresets merge like partial aggregates, and what is left is
clustered, labelled and scored. What can be a Catalyst expression is one; the reduction itself runs on Arrow batches.
"""
