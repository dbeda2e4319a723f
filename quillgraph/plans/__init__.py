"""Plan-level helpers: shared scratch tables, worker code shipping, iterative drivers."""
