"""Library queries bound to the given tables, and the SQL they are checked against."""
