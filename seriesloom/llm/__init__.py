"""Training-data pipeline operators.

Each module holds one operator with a general interface; ``registry`` holds the
thin queries that apply them to whole tables.  Nothing outside this subpackage
imports it.
"""
