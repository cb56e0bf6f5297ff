"""Composed plans: the build pipeline, the case and its views, the synthetic corpus."""
