"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`glimmer.llm.queries` derives the
registered queries from them.
"""
