"""Source catalogs: Parquet/ORC/CSV/JDBC/metastore tables and the test-data adapters."""
