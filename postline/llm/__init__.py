"""Operators of a large-scale training-data pipeline (see README, "Training-data operators").

Each module holds one operator with its own general interface; ``queries``
registers one query per operator over the whole driver tables.  Nothing
outside this subpackage imports it.
"""
