"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this subpackage.  ``queries`` registers one query per operator; every operator takes DataFrames and
column names, so it can be used on any table.
"""
