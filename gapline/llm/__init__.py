"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin queries
that apply the operators to whole tables, and ``oracles`` their SQL twins.
"""
