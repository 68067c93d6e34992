"""DataFrame-level operators over documents."""
