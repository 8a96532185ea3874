"""Operators on DataFrames: ranking, joins, islands, aggregates, graphs, clustering, mutations."""
