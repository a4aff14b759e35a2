"""streaming of relayscope."""
