"""DataFrame-to-DataFrame operators; every operator runs over all dates and panels at once."""
