"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it. ``vframe.llm.queries`` registers
one query for each operator.
"""
