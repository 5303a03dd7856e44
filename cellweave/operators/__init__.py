"""Relational operators of grid clustering: cells, stencil joins, core marks, components, labels."""
