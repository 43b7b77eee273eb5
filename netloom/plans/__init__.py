"""Test fixtures from ordinary tables, the query catalogue, and composite pipelines."""
