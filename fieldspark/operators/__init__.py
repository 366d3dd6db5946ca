"""Relational building blocks: frames, filters, equations, range joins, stencils, gates, columns."""
