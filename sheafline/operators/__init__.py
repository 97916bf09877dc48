"""DataFrame operators: every function takes and returns DataFrames, lazily unless it says otherwise."""
