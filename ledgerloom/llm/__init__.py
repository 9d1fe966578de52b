"""Operators and a pipeline for training corpora. Nothing outside this folder imports it."""
