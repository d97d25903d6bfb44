"""Operators from reads to a navigable graph."""
