"""Training-data operators over document tables (packing, scoring,
near-duplicates, scans, archives, extraction).  Nothing outside this
subpackage imports it."""
