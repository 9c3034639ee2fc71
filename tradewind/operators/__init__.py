"""Reports, listings and audits. Each operator takes the tables as a dict of DataFrames and returns a lazy DataFrame."""
