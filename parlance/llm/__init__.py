"""Operators for preparing training text: filters, joins, packing, sharding and archives.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator and ``__spark_entry__`` adds them when the subpackage is there.
"""
