"""The query set: input tables derived from the given data, queries and their SQL."""
