"""Scalar functions: PostgreSQL text forms as column expressions, binary decoders as Arrow UDFs."""
