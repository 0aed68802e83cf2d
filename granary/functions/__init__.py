"""Part of granary; see the README."""
