"""Decision operators over DataFrames. Each takes a frame, column names and ``keys`` to group by."""
