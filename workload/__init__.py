"""The registered queries: input tables derived from the given data, queries, SQL twins."""
