"""Path operators over DataFrames."""
