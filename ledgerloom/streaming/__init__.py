"""Statement text arriving as files."""
