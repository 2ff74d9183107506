"""Readers of source code: one row for each file becomes rows of nodes, edges and evidence."""
