"""Stages, pipelines of stages, their contracts and their storage."""
