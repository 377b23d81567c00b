"""Training-data operators: decontamination, fingerprints, dedup, filters, archives, sharding and packing.

Nothing outside this folder imports it; the entry module adds its queries only when the import works.
"""
