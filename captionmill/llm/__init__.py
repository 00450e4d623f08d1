"""Operators for large-scale training-data pipelines.

Each module holds one operator with a general interface; ``queries`` wires
them to the tables of a data folder. Nothing else in the package imports
this subpackage.
"""
