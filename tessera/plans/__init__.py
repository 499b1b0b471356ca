"""Multi-stage plans and their staging tables."""
