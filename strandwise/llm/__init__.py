"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator has a
module; :mod:`strandwise.llm.queries` registers one query per operator.
"""
