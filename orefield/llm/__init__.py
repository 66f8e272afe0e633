"""Training-data operators: mixing, deduplication, decontamination, scans, archives, scoring, sharding."""
