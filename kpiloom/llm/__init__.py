"""Operators for preparing training data: thirteen operators, their queries and SQL.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
registered ``opN_<name>`` queries and ``corpus_pipeline.py`` at the repository
top chains five of the operators.
"""
