"""Training-data operators: deduplication, filtering, fingerprints, mixing, sharding and archives.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` applies the operators to the standard tables.
"""
