"""Composed jobs: layer builds, the query catalog and its check SQL."""
