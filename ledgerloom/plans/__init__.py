"""Multi-step pipelines and shared plan helpers."""
