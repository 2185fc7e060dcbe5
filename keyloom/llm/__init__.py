"""Operators for preparing training corpora, and the queries that apply them.

Nothing else in the library imports this package. Every operator takes DataFrames and returns DataFrames; tables that
several steps read are written once to the shared folder of the session.
"""
