"""File discovery, scans, dimension tables and sinks."""
