"""Readers and writers of vector files and models."""
