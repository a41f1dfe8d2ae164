"""Training-data operators: deduplication, decontamination, filters, sharding and packing.

Nothing else in the package imports this subpackage.
"""
