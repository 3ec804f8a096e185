"""Policy-driven data quality over DataFrames."""
