"""Files of points, labels and coresets, and generated points."""
