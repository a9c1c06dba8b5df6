"""DDL from catalog rows: expression trees, tables, types, roles, sequences and schema objects. Metadata-sized, on the driver."""
