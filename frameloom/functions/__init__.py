"""Column functions: colour, depth and disparity arithmetic, rates, sizes and names."""
