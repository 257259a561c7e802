"""Row, window and fold operators over document tables."""
