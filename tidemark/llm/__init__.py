"""Operators for preparing language-model training corpora.

Each module holds one operator; ``queries`` registers the thin ``opN_*`` queries over the test tables.
Nothing outside this subpackage imports it.
"""
