"""Queries that apply the operators to whole tables."""
