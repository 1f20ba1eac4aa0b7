"""Browsing knowledge graphs as DataFrame transforms."""
