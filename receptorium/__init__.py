"""Receptor repertoire analytics on Spark.

Every operator takes tables (queries, sequences, records) and returns tables, so
one job answers any number of requests.
"""
