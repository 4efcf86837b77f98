"""Named queries that apply the operators to tables, with the same in SQL."""
