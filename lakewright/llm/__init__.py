"""Training-data operators: packing, scans, de-duplication, scoring, mixing and sharding."""
