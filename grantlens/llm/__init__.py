"""Training-data pipeline operators (decontamination, packing, dedup, sharding, ...).

Nothing else in the library imports this subpackage.  ``queries.py`` registers
one ``opN_<name>`` query per operator.
"""
