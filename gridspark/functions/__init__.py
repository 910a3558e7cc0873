"""Column functions and the ranking, drawing and quantile building blocks."""
