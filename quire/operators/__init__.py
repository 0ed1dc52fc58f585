"""Operators over the tables of the data model: DataFrame in, DataFrame out."""
