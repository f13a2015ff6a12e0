"""Tabular analytics and modelling on Spark DataFrames."""
