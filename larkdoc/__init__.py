"""Batch and streaming document retrieval, workspace tables and text pipelines as Spark DataFrames."""
