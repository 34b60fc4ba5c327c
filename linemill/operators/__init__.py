"""Operators on line frames: src (key), line_no (order key in src), line."""
