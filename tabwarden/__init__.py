"""tabwarden: table-in, table-out operators for making untrusted data usable, on Spark."""
