"""The logical operators of a graph query and how they become a DataFrame."""
