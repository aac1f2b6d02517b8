"""Operators for preparing language-model training data. Nothing else in quillgraph imports this subpackage."""
