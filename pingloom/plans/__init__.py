"""Plan building blocks: sliced windows, staged pipelines, relabelled tables."""
