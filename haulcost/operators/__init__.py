"""The analytical jobs, one module per study."""
