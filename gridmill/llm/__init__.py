"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries``
holds the registered queries that apply them to whole tables, and ``sql`` the
SQL that expresses some of them.  Nothing outside this subpackage imports it.
"""
