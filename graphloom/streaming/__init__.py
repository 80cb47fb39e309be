"""Resumable and streaming runs."""
