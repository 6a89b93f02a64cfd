"""Operators for preparing training text, each over whole tables of documents or pages."""
