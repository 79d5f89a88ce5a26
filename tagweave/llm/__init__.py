"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the query registry adds its queries when
the folder is present.
"""
