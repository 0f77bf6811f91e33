"""The codec on columns: exprs (code-generated) and codec (Arrow UDFs)."""
