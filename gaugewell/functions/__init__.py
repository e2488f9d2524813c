"""Column functions: text rendering, detectors, quality levels."""
