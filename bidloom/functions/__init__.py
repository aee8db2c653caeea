"""Column functions: text, numbers, position references, geometry.  All are built-in expressions, no UDFs."""
