"""Where ledgers and word lists are read from, and where results are written."""
