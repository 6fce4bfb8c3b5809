"""Composed pipelines and plan builders."""
