"""The query catalogue: each operator applied to a whole driver table, with its form in SQL where it has one."""
