"""Training-data operators: each module holds one operator that takes and
returns DataFrames; ``queries`` registers the fixed queries over them."""
