"""Sources: readers of stored case files, and case data derived from order tables."""
