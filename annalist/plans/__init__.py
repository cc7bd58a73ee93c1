"""The Datalog dialect: parsing, checks, and compilation to DataFrames."""
