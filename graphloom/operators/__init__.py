"""Physical meaning of each operator as DataFrame transformations."""
