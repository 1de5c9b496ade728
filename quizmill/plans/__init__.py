"""Resumable multi-step jobs."""
