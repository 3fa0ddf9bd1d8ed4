"""Training runs, sweeps and the registered queries."""
