"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``registry`` lists the queries
that ``__spark_entry__.py`` adds when the subpackage is present.
"""
