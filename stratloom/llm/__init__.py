"""Training-data operators: deduplication, scoring, filtering, packing and sharding of text.

Nothing outside this subpackage imports it.  Functions that run on executors live in
importable modules, so the package must be on the executors' Python path
(``--py-files`` or an installed wheel).
"""
