"""Writers and the merges in front of them."""
