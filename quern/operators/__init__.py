"""Operators over DataFrames: chunks, vectors, retrieval, answers, citations, evaluation and discovery."""
