"""Relational operators: DataFrame in, DataFrame out, for all documents or courses at once."""
