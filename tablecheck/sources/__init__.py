"""Reading tables: files by suffix, catalog tables, and databases over JDBC."""
