"""Operators that prepare text corpora for language-model training.

Ten operators, one module each; ``queries`` holds the thin ``opN_<name>`` queries. Nothing
outside this subpackage imports it.
"""
