"""sources of relayscope."""
