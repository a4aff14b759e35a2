"""operators of relayscope."""
