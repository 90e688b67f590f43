"""Part of fabula; see the package README."""
