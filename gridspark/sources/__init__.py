"""Reading and writing of partitioned grid tables, grid descriptions, scores and statistics."""
