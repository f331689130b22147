"""Where frames come from and go to: literals, CSV, Parquet."""
