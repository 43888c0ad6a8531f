"""DataFrame operators over frames, pixels and series.

Layouts: ``frame`` has one row per frame with arrays in row-major order; ``pixel`` has one row per
frame_idx, y, x. Order is never implied: every operator takes the columns that order its rows.
"""
