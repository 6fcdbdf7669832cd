"""Column to column and table to table operators."""
