"""Operators for preparing training text at scale.

Nothing outside this subpackage (and the pipeline module at the top of the
repository) imports it.  One module per operator; ``catalog`` registers their
queries, ``frames`` and ``words`` hold the Arrow and numpy helpers they share.
"""
