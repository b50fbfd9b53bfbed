"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage; remove it and the rest
still works.  Each module holds one operator with its own general interface,
and ``queries`` derives from them the digest columns that the registered
``opN_<name>`` queries return.
"""
