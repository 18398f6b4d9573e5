"""Relational operators of the issue-quality model.

Every function takes DataFrames and a ``by`` list of grouping keys and returns
a lazy DataFrame; nothing is collected to the driver.
"""
