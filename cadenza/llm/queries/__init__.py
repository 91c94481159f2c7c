"""Queries over the benchmark tables, one module per problem."""
