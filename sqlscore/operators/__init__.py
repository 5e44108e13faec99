"""Operators: each a lazy DataFrame -> DataFrame transform."""
