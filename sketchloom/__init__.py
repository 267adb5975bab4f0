"""Bitmap-sketch analytics on Spark DataFrames.

A sketch is the relation DISTINCT (reg, zeros) of a token set; every operator
here is a join, an aggregation or a window over that relation.
"""
