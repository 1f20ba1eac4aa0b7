"""Operators for preparing training data: nine self-contained problems over the browsing tables."""
