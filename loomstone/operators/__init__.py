"""Operators on evaluation tables: confusion, metrics, linking, graphs, grids."""
