"""The windowed reports as streams."""
