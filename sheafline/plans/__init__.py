"""Ready-made flows over the operators, and the views and queries on the driver tables."""
