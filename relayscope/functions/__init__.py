"""functions of relayscope."""
