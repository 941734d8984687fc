"""Functions of the engine; every public name maps DataFrames to DataFrames or builds column expressions."""
