"""Operators for preparing text corpora for training, each usable on any DataFrame with the named columns.

Every operator reads only the columns it is told to read and returns only its own columns, so further columns of the
input, whatever their names, neither reach the result nor clash with it.
"""
