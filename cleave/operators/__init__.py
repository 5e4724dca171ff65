"""Graph operators on edge, label and triangle DataFrames."""
