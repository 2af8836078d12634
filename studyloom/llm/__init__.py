"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  `registry` lists the
queries and the SQL that belong to it.
"""
