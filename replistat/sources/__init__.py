"""Reading file inventories and run tables, writing fixed-order result tables."""
