"""Row-wise plans over streams."""
