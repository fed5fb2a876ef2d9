"""Warehouse-load operators."""
